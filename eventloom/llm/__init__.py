"""Operators for large-scale training-data pipelines; nothing outside this subpackage imports it."""
