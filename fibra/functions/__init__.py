"""Shared kernels: windows, statistics, spectra."""
