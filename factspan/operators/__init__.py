"""Operators on facts, claims, grids and texts."""
