"""Functions of the findings analytics engine."""
