"""Operators: DataFrame in, DataFrame out, nothing collected unless a bound is checked."""
