"""Column helpers and byte kernels."""
