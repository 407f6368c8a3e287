"""Column functions on text and vectors."""
