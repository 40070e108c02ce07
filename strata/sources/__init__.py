"""Sources of strata."""
