"""Sphere analytics on Spark: grids, fields, graphs, stores and ledgers as DataFrames."""
