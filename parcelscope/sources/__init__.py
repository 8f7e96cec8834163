"""Readers and writers of the delivery tables."""
