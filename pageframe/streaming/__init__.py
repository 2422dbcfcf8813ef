"""Structured Streaming operators over the edit log."""
