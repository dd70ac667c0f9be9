"""Column functions: routing, key encoding, handles, error classes."""
