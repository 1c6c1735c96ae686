"""Spark-native operators for document retrieval, model-operations analytics and deck quality."""
