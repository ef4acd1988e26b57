"""Pure functions: options, kernels, and the arithmetic of grids and pyramids."""
