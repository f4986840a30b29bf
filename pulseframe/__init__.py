"""Wearable-health and training analytics as PySpark DataFrame transformations."""
