"""Column expressions: every function takes and gives Spark columns."""
