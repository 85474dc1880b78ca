"""Semantics of single values and predicates."""
