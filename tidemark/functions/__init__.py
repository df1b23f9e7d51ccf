"""Scalar functions whose results stay defined under ANSI mode."""

from tidemark.functions.scalars import (
    absolute,
    ceiling,
    constant,
    either,
    field,
    floored,
    int_div,
    int_mod,
    larger,
    new,
    power,
    root,
    safe_div,
    smaller,
    tick,
    to_type,
)

__all__ = ["absolute", "ceiling", "constant", "either", "field", "floored", "int_div", "int_mod", "larger", "new", "power", "root", "safe_div", "smaller", "tick", "to_type"]
