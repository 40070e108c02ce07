"""Queries of strata."""
