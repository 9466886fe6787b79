"""Spark-native analytics over source-code repositories and text corpora."""
