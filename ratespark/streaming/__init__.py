"""Structured Streaming quote pipeline."""
