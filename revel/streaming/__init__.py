"""Streaming entry points (the reference itself is batch only)."""
