"""Engine operators: each takes and returns DataFrames."""
