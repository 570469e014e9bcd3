"""Column builders. Everything here is a plain Spark expression."""
