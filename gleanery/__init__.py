"""Spark-native engine for curating labelled datasets and evaluating classifiers on them."""

__version__ = "0.1.0"
