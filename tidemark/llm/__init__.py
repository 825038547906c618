"""Operators for building training data from documents. Nothing else in the library imports this package."""
