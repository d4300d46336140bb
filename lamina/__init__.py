"""Lamina: topic segmentation, alignment and corpus operators as PySpark plans."""

__version__ = "0.1.0"
