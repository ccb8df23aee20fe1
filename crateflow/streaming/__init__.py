"""Streaming additions."""
