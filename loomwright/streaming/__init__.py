"""Structured Streaming forms of the log and staging operators."""
