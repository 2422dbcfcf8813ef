"""Column expressions: geometry, scripts, strings, styles."""
