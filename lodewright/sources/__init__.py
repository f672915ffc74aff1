"""Readers that turn files and version-control history into DataFrames."""
