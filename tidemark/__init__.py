"""Outcome analytics on Spark: point-in-time labels, leak-safe features, calibrated decisions."""
