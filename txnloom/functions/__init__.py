"""Column builders: native Spark expressions, usable in batch and streams."""
