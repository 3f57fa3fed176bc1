"""Queries over the test tables: one operator each, with its SQL."""
