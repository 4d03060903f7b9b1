"""Forgeframe: a PySpark-native analytics engine for tabular property data."""
