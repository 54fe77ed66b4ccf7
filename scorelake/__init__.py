"""scorelake: Spark-native analytics over ensemble score tables and training data."""

__version__ = "0.1.0"
