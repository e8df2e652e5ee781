"""Readers that turn files and exports into DataFrames."""
