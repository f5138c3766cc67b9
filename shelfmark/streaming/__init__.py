"""Structured Streaming shells over the batch operators."""
