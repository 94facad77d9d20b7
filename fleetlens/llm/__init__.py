"""Operators for large training-data pipelines, with their queries."""
