"""Operators on DataFrames: statistics, reshaping, series, rasters, objects, and spatial joins."""
