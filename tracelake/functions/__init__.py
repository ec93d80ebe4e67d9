"""Column functions: temporal logic, text, hashing."""
