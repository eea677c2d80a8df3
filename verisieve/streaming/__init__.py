"""Stateful Structured Streaming: partial responses, session symbols, caches."""
