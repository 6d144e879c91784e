"""Spark-native engine for searching and analysing source code and documents."""
