"""Spark-native knowledge query engine: text, graph and vector retrieval as DataFrame operators."""

__version__ = "0.1.0"
