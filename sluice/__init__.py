"""Spark-native analytics over records that move through stages."""
