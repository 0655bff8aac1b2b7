"""Structured Streaming forms of the event detectors."""
