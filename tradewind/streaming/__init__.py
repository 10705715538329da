"""Structured Streaming entry points around the batch operators."""
