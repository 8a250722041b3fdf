"""Plans of the decision-analytics engine."""
