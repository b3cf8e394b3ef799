"""Scalar building blocks: geometry, statistics, identifiers."""
