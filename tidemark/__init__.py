"""tidemark: a Spark-native analytics library."""
