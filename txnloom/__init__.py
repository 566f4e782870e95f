"""Transaction-risk analytics as plain Spark DataFrame operators."""
