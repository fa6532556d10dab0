"""Column functions on texts and token arrays."""
