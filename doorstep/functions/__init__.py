"""Column expressions and small driver-side scalar helpers."""
