"""Reconstruction algorithms as driver loops over distributed operators."""
