"""Stateful transforms for Structured Streaming."""
