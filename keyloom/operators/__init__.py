"""Operators on keyed tables."""
