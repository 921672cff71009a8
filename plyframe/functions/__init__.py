"""Column functions: text, geometry and board values, all built from Spark's own functions."""
