"""Longitudinal, per-subject event analytics as Spark DataFrame transformations."""
