"""Spark-native alignment-depth analytics."""

__version__ = "0.2.0"
