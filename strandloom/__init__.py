"""A PySpark-native engine for variant screening."""
