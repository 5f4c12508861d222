"""Spark-native code and document graph analytics."""
