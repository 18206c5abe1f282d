"""Structured Streaming forms of the polled workflows."""
