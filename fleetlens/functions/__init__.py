"""Scalar functions and time helpers."""
