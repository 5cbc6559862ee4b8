"""siftlark: a PySpark-native engine for evidence-based record matching."""
