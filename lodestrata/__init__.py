"""Spark-native retrieval, curation and time-series analytics engine."""
