"""Column expressions: labels, numbers and units, periods."""
