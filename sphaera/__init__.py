"""Geometry of large sets of overlapping spheres as Spark DataFrames."""
