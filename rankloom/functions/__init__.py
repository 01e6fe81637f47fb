"""Column expressions and small DataFrame helpers with no domain tables of their own."""
