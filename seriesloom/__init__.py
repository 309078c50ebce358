"""Spark-native preparation, audit, sampling and scoring of sensor series."""
