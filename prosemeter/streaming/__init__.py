"""Structured Streaming jobs over request and response directories."""
