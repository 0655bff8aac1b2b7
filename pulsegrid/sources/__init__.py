"""Reading and writing rasters, traces, matrices and results."""
