"""Spark-native analytics for social-channel content: metrics, reach, threads, retrieval, corpus preparation."""
