"""Column functions: scalars, mergeable statistics and feature formulas."""
