"""Spark-native engine for large corpora of books and web-style documents."""
