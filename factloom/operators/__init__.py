"""Operators of the findings analytics engine."""
