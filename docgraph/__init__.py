"""A Spark-native engine for document graphs, retrieval and evaluation."""
