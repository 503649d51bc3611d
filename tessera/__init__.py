"""Spark-native retrieval analytics: pages to cited answers as DataFrame plans."""
