"""Structured Streaming forms of the engine's running aggregates and keyed state."""
