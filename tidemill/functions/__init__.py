"""Column expressions and pattern translation."""
