"""Spark-native text analytics and evaluation engine."""
