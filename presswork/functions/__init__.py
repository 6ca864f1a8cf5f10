"""Column builders: text, URLs, vectors, JSON, classification."""
