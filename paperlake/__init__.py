"""A PySpark-native engine for research-document collections."""
