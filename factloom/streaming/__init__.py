"""Streaming of the findings analytics engine."""
