"""Spark-native analytics over timed text observations."""

__version__ = "0.1.0"
