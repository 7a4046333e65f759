"""Stratalith: a PySpark-native governed analytics and data-preparation engine."""

__version__ = "0.1.0"
