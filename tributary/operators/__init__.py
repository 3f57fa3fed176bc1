"""Relational and order-dependent operators: DataFrame in, DataFrame out."""
