"""Predicates, names, preconditions and the provenance log."""
