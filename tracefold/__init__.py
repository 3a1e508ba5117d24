"""Spark-native analytics over work-activity traces and the knowledge distilled from them."""

__version__ = "0.1.0"
