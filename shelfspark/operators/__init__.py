"""Operators on tables of records, indexes and requests."""
