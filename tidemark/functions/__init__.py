"""Scalar functions: arithmetic, classification and text, as Column expressions."""
