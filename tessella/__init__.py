"""tessella: a Spark-native engine for retrieval-evaluation analytics and data preparation."""
