"""Spark-native analytics over repositories, decision records and coding-agent sessions."""

__version__ = "0.1.0"
