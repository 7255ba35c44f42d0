"""Column functions and per-row text steps."""
