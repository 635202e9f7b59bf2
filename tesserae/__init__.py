"""Layered rasters, image catalogues and edit sessions as Spark DataFrames."""
