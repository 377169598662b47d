"""Spark-native analytics over property graphs of source code."""
