"""Scalar and array functions as Column expressions."""
