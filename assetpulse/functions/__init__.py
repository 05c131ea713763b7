"""Column expressions: rounding, time axis, geometry, rules and texts."""
