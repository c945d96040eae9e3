"""Spark-native analytics for large social-interaction graphs."""
