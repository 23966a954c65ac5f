"""Structured Streaming jobs and the readers of their change logs."""
