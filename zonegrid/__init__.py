"""A Spark-native engine for origin-destination matrices."""
