"""A Spark-native analytics engine for wide clickstream tables."""
