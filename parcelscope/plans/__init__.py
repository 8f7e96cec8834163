"""Composite results built from the operators."""
