"""Spark-native mass-spectrometry analytics."""
