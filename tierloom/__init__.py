"""Gated batch classification on Spark."""
