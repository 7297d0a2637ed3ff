"""Spark-native analytics for time-stamped tracks, detection scores and human labels."""
