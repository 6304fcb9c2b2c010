"""Column functions: content addresses, names, text rules."""
