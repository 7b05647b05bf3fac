"""Operators for training-data pipelines. Nothing else in foliant imports this package."""
