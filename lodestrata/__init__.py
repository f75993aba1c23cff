"""Spark-native document indexing, chunking and vector retrieval."""
