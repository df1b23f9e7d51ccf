"""Temporal analytics on Spark DataFrames.

A stream is a DataFrame of non-overlapping validity intervals ``(st, et]`` per
key; see ``tidemark.stream.TStream`` for the operators.
"""

from tidemark.stream import TStream

__all__ = ["TStream"]
