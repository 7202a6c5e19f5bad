"""Spark-native search and ranking, and operators for training data."""
