"""Spark-native semantic metrics engine."""

__version__ = "0.1.0"
