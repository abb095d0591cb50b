"""Spark-native engine for panels of daily series and the texts around them."""

__version__ = "0.1.0"
