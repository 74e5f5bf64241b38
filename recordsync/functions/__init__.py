"""Column expressions that the operators are made of."""
