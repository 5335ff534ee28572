"""Spark-native analytics for speech and text corpora: every operator is a DataFrame transformation."""
