"""Operators for building and checking training corpora. Nothing else in the library imports this package."""
