"""Spark-native analytics for question answering, retrieval and answer faithfulness."""
