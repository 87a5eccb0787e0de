"""Compositions of operators and the query registry."""
