"""Spark-native memory-retrieval analytics: time-coded captions, fact graphs, vectors, evaluation logs."""
