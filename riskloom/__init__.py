"""Spark-native credit-risk features, feature store and evaluation."""
