"""Column expressions: declared readings, and the tests a value must pass."""
