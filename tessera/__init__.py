"""Spark-native evidence retrieval, corpus analytics and maintenance operators."""
