"""Column expressions: scalars, text parsing and geometry."""
