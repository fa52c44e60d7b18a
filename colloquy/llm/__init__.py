"""Operators for large training-data pipelines; nothing in the core imports this package."""
