"""Batch operators, one module for each family: DataFrame in, DataFrame out."""
