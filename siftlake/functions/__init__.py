"""Scalar functions, as SQL expression text and as columns."""
