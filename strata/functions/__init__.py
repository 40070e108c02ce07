"""Functions of strata."""
