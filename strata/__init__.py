"""Strata: lakehouse, vault, quality and governance operators on Spark DataFrames."""
