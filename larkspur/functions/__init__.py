"""Column expressions: types and literals, ranges, full text, vectors, JSON, names."""
