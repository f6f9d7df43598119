"""Operators for pipelines over training text. Nothing else in the library imports this subpackage."""
