"""Bounded iteration over a matrix."""
