"""Spark-native analysis, retrieval and assessment over collections of text documents."""
