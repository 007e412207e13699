"""Spark-native product entity resolution."""
