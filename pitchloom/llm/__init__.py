"""Operators for training-data pipelines, and their queries in ``queries``."""
