"""Structured Streaming jobs over review arrivals."""
