"""Lazy operators over frames with symbol, time, seq and payload columns."""
