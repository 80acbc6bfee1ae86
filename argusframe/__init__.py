"""Surveillance-evidence analytics as PySpark DataFrame and streaming operators."""

__version__ = "0.1.0"
