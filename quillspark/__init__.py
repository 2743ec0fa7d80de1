"""A PySpark-native engine for searching and preparing document collections."""
