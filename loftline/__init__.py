"""Spark-native analytics over tracks, descriptors and relative-pose graphs."""
