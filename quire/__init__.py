"""Document analytics as plain Spark DataFrames."""
