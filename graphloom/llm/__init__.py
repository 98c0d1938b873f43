"""Operators for preparing model training data. Nothing else in the package imports this subpackage."""
