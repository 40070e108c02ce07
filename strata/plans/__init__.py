"""Plans of strata."""
