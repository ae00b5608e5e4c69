"""Column expressions: indices, coordinates, statistics."""
