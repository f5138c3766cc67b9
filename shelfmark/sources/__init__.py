"""Readers: JSON products in batch or as a stream, and frames derived from star-schema tables."""
