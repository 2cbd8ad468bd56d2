"""Operators for preparing large text and vector collections. Nothing else in the library imports this package."""
