"""Typed readers and append-only writers."""
