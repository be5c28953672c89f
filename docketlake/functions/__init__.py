"""Column functions: case numbers, legal references, text, vectors, bibliographic fields."""
