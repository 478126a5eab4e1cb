"""A Spark-native engine for code search and repository knowledge."""
