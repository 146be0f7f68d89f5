"""Structured Streaming jobs over event and log sources."""
