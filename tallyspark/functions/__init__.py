"""Column functions, built of Spark's own functions."""
