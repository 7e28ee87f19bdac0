"""Tensor fields on periodic grids as Spark DataFrames."""
