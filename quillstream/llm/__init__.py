"""Operators for training-data pipelines: one module for each, and `entries` with their registered queries."""
