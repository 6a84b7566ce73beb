"""Operators for language-data preparation. Nothing else in the library imports this package."""
