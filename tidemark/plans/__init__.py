"""Operator trees of streams."""

from tidemark.plans.tree import Node

__all__ = ["Node"]
