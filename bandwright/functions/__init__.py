"""Column expressions: text, vectors, statistics."""
