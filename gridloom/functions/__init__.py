"""Kernels, argument checks and column expressions."""
