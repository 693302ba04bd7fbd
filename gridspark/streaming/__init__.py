"""Structured Streaming forms. Each agrees with a batch operator over the same rows."""
