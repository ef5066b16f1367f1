"""Incremental execution on streams."""
