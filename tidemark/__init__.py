"""Spark-native analytics engine for pre-event prediction data sets."""
