"""Streaming of the decision-analytics engine."""
