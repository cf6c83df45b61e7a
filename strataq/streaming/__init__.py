"""Structured Streaming forms of the write log and the event log."""
