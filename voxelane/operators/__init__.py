"""Grouped kernels and relational operators over movies, traces and components."""
