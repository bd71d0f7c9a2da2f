"""Readers of the tables."""
