"""Structured Streaming forms of the time-driven and keyed rules."""
