"""Structured Streaming jobs. Each windowed aggregate is one function used by its batch twin too."""
