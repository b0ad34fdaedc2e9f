"""Spark-native data profiling, quality auditing, cleaning and insight engine."""

__version__ = "0.1.0"
