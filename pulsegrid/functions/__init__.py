"""Column functions: scalars, array kernels and Arrow-backed spectral kernels."""
