"""Scalar column functions, vector functions and pluggable models."""
