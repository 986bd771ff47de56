"""Pitch-contour analytics as Spark DataFrame operators."""
