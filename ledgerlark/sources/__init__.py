"""Readers, writers and versioned sinks."""
