"""Plateworks: a PySpark-native engine for technical-drawing datasets."""
