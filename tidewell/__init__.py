"""Spark-native retrieval, text and analytics operators."""
