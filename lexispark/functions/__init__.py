"""Column functions: text, identifiers, paths, labels, vectors and formats."""
