"""Column functions of elements."""
