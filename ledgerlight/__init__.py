"""Spark-native spending-risk analytics engine."""
