"""Spark-native analytics for large collections of brightness time series."""
