"""Rasters, ink separations, screens, stencils and corpus pipelines as Spark DataFrames."""
