"""A PySpark-native code-intelligence and analytics engine."""
