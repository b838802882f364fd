"""Readers that turn scanner files and phantoms into DataFrames."""
