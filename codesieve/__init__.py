"""PySpark-native analytics over code and text corpora."""

__version__ = "0.1.0"
