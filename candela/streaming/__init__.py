"""Indicators over unbounded bar streams, with the kernels of the batch scan."""
