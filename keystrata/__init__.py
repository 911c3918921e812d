"""A Spark-native analytics engine for typed, keyed records."""
