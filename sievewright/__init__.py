"""Spark-native engine for curating large record collections."""
