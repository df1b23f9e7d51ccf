"""Streams from events, intervals and files, and back to files."""

from tidemark.sources.intervals import checked_intervals, fixed_intervals, read_events, to_intervals, write_intervals

__all__ = ["checked_intervals", "fixed_intervals", "read_events", "to_intervals", "write_intervals"]
