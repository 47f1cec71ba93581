"""Spark-native analytics for operational finance data and project mail."""
