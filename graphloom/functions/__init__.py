"""Scalar text, similarity and scoring functions as Column expressions."""
