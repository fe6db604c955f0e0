"""Spark-native lead and disruption analytics."""
