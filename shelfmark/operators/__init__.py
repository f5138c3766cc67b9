"""Operators: pure DataFrame -> DataFrame transformations."""
