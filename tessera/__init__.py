"""Geometry and dimension reduction of vector clouds on Spark DataFrames."""
