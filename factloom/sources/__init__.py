"""Sources of the findings analytics engine."""
