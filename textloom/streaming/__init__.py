"""Structured Streaming: documents become searchable per micro-batch."""
