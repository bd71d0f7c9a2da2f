"""Operators: DataFrame in, DataFrame out, per group."""
