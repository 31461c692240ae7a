"""Column expressions (X1-X10) and small shared helpers."""
