"""A Spark-native lake and retrieval engine for storm bulletins."""
