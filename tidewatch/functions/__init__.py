"""Column to column functions."""
