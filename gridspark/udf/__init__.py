"""Arrow kernels and SQL-callable functions."""
