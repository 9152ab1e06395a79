"""A Spark-native engine for a compact relational dialect."""
