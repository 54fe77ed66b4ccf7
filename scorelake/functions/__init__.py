"""Column expressions and task-side numeric helpers."""
