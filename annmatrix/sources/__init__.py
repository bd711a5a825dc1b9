"""Stores, matrices and file formats."""
