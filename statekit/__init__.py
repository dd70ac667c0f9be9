"""Keyed state on Spark: batch and streaming operators over change logs and state tables."""
