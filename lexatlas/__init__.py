"""Spark-native analytics for structured document corpora."""
