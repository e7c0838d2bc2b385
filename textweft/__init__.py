"""textweft: a PySpark-native engine that finds shared passages in collections of symbol sequences."""

__version__ = "0.1.0"
