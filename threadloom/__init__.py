"""Spark-native analytics for review discussions and the papers they discuss."""
