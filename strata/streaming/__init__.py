"""Streaming of strata."""
