"""A Spark-native engine for multi-dimensional box queries."""
