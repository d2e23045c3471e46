"""Spark-native image-encoding analytics."""
