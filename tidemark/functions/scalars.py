"""Scalar expressions.

Plus, minus, times, comparisons and boolean operators are Spark's own on
columns.  The functions here fix what differs between engines: integers divide
towards zero, a division by zero is null, float-to-int casts truncate, floor
and ceiling keep a float type, and the larger or smaller of two numbers is null
where one is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGERS = {"byte", "short", "int", "integer", "long", "bigint", "smallint", "tinyint"}
#: Bits of unsigned types, and the type that holds them.
UNSIGNED = {"ubyte": (8, "short"), "ushort": (16, "int"), "uint": (32, "long")}


def tick(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def constant(value, kind: str) -> Column:
    return F.lit(value).cast(kind)


def int_div(a, b) -> Column:
    """Quotient of integers towards zero, as long; null for a divisor of zero."""
    return F.call_function("div", _column(a).cast("long"), F.nullif(_column(b).cast("long"), F.lit(0).cast("long")))


def int_mod(a, b) -> Column:
    """Remainder with the sign of the dividend; null for a divisor of zero."""
    return _column(a) % F.nullif(_column(b), F.lit(0))


def safe_div(a, b) -> Column:
    """Quotient as double; null for a divisor of zero."""
    return F.try_divide(_column(a).cast("double"), _column(b).cast("double"))


def larger(a, b) -> Column:
    a, b = _column(a), _column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a, b) -> Column:
    a, b = _column(a), _column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def absolute(a) -> Column:
    return F.abs(_column(a))


def root(a) -> Column:
    return F.sqrt(_column(a).cast("double"))


def power(a, b) -> Column:
    return F.pow(_column(a).cast("double"), _column(b).cast("double"))


def ceiling(a) -> Column:
    return F.ceil(_column(a)).cast("double")


def floored(a) -> Column:
    return F.floor(_column(a)).cast("double")


def to_type(a, kind: str) -> Column:
    """Cast between numbers; floats become integers towards zero, and null out of the type's range.

    Spark has no unsigned types: ``ubyte``, ``ushort`` and ``uint`` are held by
    the next wider type, and numbers wrap as unsigned ones of that width do.
    """
    if kind in UNSIGNED:
        bits, wider = UNSIGNED[kind]
        return F.pmod(_column(a).try_cast("long"), F.lit(1 << bits)).cast(wider)
    if kind in INTEGERS:
        return _column(a).try_cast(kind)
    return _column(a).cast(kind)


def new(*fields) -> Column:
    """Struct with the positional fields ``_0``, ``_1``, ..."""
    return F.struct(*(_column(x).alias(f"_{i}") for i, x in enumerate(fields)))


def field(struct: Column, position: int) -> Column:
    return struct.getField(f"_{position}")


def either(condition: Column, yes, no) -> Column:
    """``yes`` where the condition holds, else ``no`` (also where it is null)."""
    return F.when(condition, _column(yes)).otherwise(_column(no))
