"""Spark-native document intelligence: page quality, cleaning, grouping, chunking, retrieval, evaluation."""

__version__ = "0.1.0"
