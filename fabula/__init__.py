"""Narrative statements from large text collections, on Spark."""

__version__ = "0.1.0"
