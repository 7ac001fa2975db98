"""Spark-native analytics for short posts grouped by match and period."""

__version__ = "0.1.0"
