"""Structured Streaming jobs whose final answers equal a batch operator's."""
