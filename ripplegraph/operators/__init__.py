"""Joins, traversals and reports over the dependency graph."""
