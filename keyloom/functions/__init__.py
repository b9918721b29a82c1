"""Scalar functions built from native column expressions."""
