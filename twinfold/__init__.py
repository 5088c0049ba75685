"""Spark-native content deduplication: what is duplicated, what to keep, what a clean-up would do."""

__version__ = "0.1.0"
