"""Functions of the decision-analytics engine."""
