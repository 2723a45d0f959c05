"""Spark-native engine for building, maintaining and querying document corpora."""
