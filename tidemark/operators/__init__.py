"""Temporal operators; ``tidemark.stream.TStream`` has them as methods."""
