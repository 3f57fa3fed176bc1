"""Whole programs composed of the operators."""
