"""Spark-native knowledge-feed engine."""
