"""Lectern: a PySpark-native engine for document collections, search and evaluation."""

__version__ = "0.1.0"
