"""Shelfmark: product-catalog search, keyed loads and blue/green publishing on Spark."""

__version__ = "0.1.0"
