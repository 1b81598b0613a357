"""Features of regions: SQL expressions and geometry kernels."""
