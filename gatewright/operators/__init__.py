"""Operators of the decision-analytics engine."""
