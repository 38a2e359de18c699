"""Structured Streaming into and out of a store."""
