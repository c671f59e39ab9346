"""Readers, sinks and the logical model."""
