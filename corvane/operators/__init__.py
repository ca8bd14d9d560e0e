"""Operators on frames of records."""
