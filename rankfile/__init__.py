"""Spark-native analytics for annotated-text corpora."""
