"""Column functions: geometry, text, identity."""
