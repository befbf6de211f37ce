"""Column expressions: geometry, labels, vectors."""
