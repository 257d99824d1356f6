"""tamis: a PySpark-native engine that finds, validates, rates, masks and reports personal data in document collections."""
