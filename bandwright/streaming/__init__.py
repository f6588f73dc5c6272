"""Structured Streaming editions of the stateful operators."""
