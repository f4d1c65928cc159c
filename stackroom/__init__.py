"""A Spark-native engine for searchable, citable document archives."""
