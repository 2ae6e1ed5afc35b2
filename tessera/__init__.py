"""Spark-native retrieval and knowledge-state analytics."""
