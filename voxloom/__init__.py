"""Volumetric analytics on PySpark."""
