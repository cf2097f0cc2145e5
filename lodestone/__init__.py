"""A PySpark-native engine for keyed documents."""
