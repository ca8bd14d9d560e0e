"""Readers of landed files and reference data."""
