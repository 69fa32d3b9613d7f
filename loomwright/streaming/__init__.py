"""Structured Streaming over traces and logs."""
