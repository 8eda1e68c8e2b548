"""Spark-native similarity search and data processing over site-tagged vectors."""

__version__ = "0.1.0"
