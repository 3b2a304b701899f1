"""Structured Streaming forms of the journal and signal operators."""
