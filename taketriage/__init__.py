"""A PySpark-native engine for triaging machine-generated media takes."""

__version__ = "0.1.0"
