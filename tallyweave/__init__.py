"""Spark-native differential analytics: DataFrame operators for comparing, scoring and auditing data and text."""

__version__ = "0.1.0"
