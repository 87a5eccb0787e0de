"""Spark-native analytics for imaging movies, traces and training-data text."""
