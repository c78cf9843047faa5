"""Spark-native analytics for labelled, time-stamped text corpora."""
