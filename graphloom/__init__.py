"""Spark-native property-graph, retrieval and text analytics engine."""

__version__ = "0.1.0"
