"""Tidewell: Spark-native analytics for equity research and text corpora."""
