"""Structured Streaming jobs over event files."""
