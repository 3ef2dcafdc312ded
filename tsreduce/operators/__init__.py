"""Relational views, reshaping, representative periods and weights."""
