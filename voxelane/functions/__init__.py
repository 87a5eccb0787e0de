"""Scalar and window expressions over columns."""
