"""Spark-native analytics for semantic-ID recommendation data."""
