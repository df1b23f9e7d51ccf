"""Structured Streaming variants."""

from tidemark.streaming.operators import hopping, interval_join, live_intervals

__all__ = ["hopping", "interval_join", "live_intervals"]
