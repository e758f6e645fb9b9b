"""Catalogue analytics as PySpark DataFrame operators."""
