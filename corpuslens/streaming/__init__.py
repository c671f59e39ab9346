"""Structured Streaming and run control."""
