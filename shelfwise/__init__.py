"""A PySpark-native retail analytics engine."""

__version__ = "0.1.0"
