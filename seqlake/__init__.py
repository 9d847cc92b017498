"""Spark-native analytics for symbol sequences and statistical profiles."""
