"""Spark-native analytics for video-frame classification logs."""
