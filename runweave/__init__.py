"""Spark-native analytics for CI run histories, import graphs and test selection."""

__version__ = "0.1.0"
