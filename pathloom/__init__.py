"""Spatial-network and operational analytics as plain PySpark DataFrame operators."""
