"""Plans of the findings analytics engine."""
