"""A PySpark-native statistics engine."""
