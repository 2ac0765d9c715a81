"""Column-level functions: numbers, text, markets and classification bands."""
