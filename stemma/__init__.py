"""stemma: a PySpark-native engine for typed argument graphs over document collections."""
