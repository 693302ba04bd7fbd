"""Column functions. Missing values are NULL everywhere; every function says what NULL gives."""
