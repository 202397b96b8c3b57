"""Structured-streaming forms of the ordered-trace operators."""
