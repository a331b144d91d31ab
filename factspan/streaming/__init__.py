"""Structured Streaming: stage times and windowed counts."""
