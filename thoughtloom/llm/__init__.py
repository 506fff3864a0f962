"""Operators for training-data pipelines, each with its own module."""
