"""Sources of the decision-analytics engine."""
