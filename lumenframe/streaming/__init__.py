"""Structured Streaming forms of the incremental operators."""
