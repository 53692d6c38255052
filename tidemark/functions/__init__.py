"""Column expressions: no jobs, no joins, only built-in Spark functions."""
