"""Operators for preparing training data. Nothing else in the library imports this subpackage."""
