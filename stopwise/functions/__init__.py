"""Column expressions: keys, bins, scalar features, formulas."""
