"""Spark-native analytics over compressed mini-batches."""
