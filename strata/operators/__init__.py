"""Operators of strata."""
