"""Column functions: URL normalization and contains-any matching."""
