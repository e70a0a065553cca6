"""Spark-native analytics for document-screening and monitoring pipelines."""
