"""Millrace: a PySpark-native engine for record queries and data pipelines."""
