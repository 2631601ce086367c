"""Operators for training-data pipelines over text, vectors and pages. Nothing else in the library imports this subpackage."""
