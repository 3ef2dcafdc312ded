"""Distances and projections."""
