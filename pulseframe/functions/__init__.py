"""Column-level building blocks and NumPy kernels."""
