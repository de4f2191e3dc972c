"""PySpark-native sensitive-content analytics."""
