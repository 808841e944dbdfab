"""Operators for large training-data pipelines, and their registered queries."""
