"""Operators for building training data at scale. Nothing else in the package imports this folder."""
