"""A Spark-native analytics engine for vector collections."""
