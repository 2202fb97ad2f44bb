"""Spark-native analytics for property graphs of named entities, text and vectors."""

__version__ = "0.1.0"
