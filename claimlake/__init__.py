"""A PySpark-native engine for verified claims."""
