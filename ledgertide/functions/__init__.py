"""Column expressions: keys, decimals, text codes."""
