"""Spark-native analytics over ordered perception records and training-data corpora."""
