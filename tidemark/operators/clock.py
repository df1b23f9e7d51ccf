"""Clocks, sampling, resampling and recurrences."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.align import floor_div, floor_grid

#: Steps of a recurrence that are copied with each other.
CHUNK = 256


def _by(keys: list[str], order: str = "et"):
    return Window.partitionBy(*keys).orderBy(order)


def ticks(df: DataFrame, period: int, origin: int = 0, name: str = "t") -> DataFrame:
    """A row for each grid time in ``(st, et]``."""
    first, last = floor_grid(F.col("st"), period, origin) + F.lit(period), floor_grid(F.col("et"), period, origin)
    out = df.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b")
    return out.withColumn(name, F.explode(F.sequence("_a", "_b", F.lit(period).cast("long")))).drop("_a", "_b")


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name, where null equals null; the right ones' copies are dropped."""
    own = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (left[c].eqNullSafe(own[f"_r_{c}"]) for c in on))
    return left.join(own, same, how).drop(*(f"_r_{c}" for c in on))


def beside(df: DataFrame, keys: list[str], time: str, value: Column, name: str, before: bool = True, ties: list[str] | None = None, slab: int | None = None, reach: int | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the key's previous row in the order of ``time`` and ``ties`` (with ``before`` false of the next), null where there is none.

    With ``slab``, time is cut into slabs of that width, each a task of its own,
    so that a hot key, or a stream without keys, is many; a slab's last (first)
    row is carried to the next one that has rows, through one row for each slab.
    With ``reach``, rows more than that apart need not be found, and slabs are
    only carried as far.
    """
    order = [time, *(ties or [])]
    beyond = F.lag if before else F.lead
    if not slab:
        return df.withColumn(name, beyond(value).over(Window.partitionBy(*keys).orderBy(*order)))
    by = [*keys, "_slab"]
    own = df.withColumn("_slab", floor_div(F.col(time), slab))
    held = own.withColumn(name, beyond(F.struct(value.alias("v"))).over(Window.partitionBy(*by).orderBy(*order)))
    edges = own.groupBy(*by).agg((F.max_by if before else F.min_by)(F.struct(value.alias("v")), F.struct(*order)).alias("_v"))
    if reach is None:
        edges = edges.withColumn("_v", beyond("_v").over(Window.partitionBy(*keys).orderBy("_slab")))
    else:
        far = F.lit(-(-reach // slab)).cast("long")
        near = F.sequence(F.col("_slab") + 1, F.col("_slab") + far) if before else F.sequence(F.col("_slab") - far, F.col("_slab") - 1)
        edges = edges.withColumn("_from", F.col("_slab")).withColumn("_slab", F.explode(near)).groupBy(*by).agg((F.max_by if before else F.min_by)("_v", "_from").alias("_v"))
    return matched(held, edges, by, "left").withColumn(name, F.coalesce(name, "_v")["v"]).drop("_slab", "_v")


def paired(df: DataFrame, keys: list[str], value: str, slab: int | None = None) -> DataFrame:
    """An interval between each two samples without a gap: ``sv`` at ``st`` and ``ev`` at ``et``."""
    out = beside(df, keys, "et", F.struct(F.col("et").alias("t"), F.col(value).alias("v")), "_p", slab=slab)
    return out.filter(F.col("_p.t") == F.col("st")).select(*keys, F.col("_p.v").alias("sv"), "st", "et", F.col(value).alias("ev"))


def interpolated(pairs: DataFrame, keys: list[str], period: int, origin: int, value: str) -> DataFrame:
    """Linear values at the grid times of the pairs, each for the ``period`` up to it."""
    at = ticks(pairs, period, origin)
    v = (F.col("ev") - F.col("sv")) * (F.col("t") - F.col("st")) / (F.col("et") - F.col("st")) + F.col("sv")
    return at.select(*keys, (F.col("t") - F.lit(period)).alias("st"), F.col("t").alias("et"), v.alias(value))


def filled(df: DataFrame, keys: list[str], payload: list[str], until: int | None, slab: int | None = None) -> DataFrame:
    """Each value holds on until the key's next one, the last until ``until``."""
    out = beside(df, keys, "st", F.col("st"), "_next", before=False, slab=slab)
    end = F.coalesce("_next", F.greatest("et", F.lit(until).cast("long")) if until is not None else F.col("et"))
    return out.select(*keys, "st", end.alias("et"), *payload)


def running(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over all of the key's intervals so far."""
    w = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})


def recurrence(df: DataFrame, keys: list[str], payload: list[str], init: Column, step: Callable[..., Column], name: str, back: int = 1) -> DataFrame:
    """``out = step(earlier outs, x)`` along each key's intervals, within generated code.

    ``step`` gets the previous out, or with ``back`` over 1 a function that gives
    the out of so many steps ago; ``init`` stands for those before the first.
    Outs are put together in chunks, so the time is in proportion to a key's
    intervals.  The fold holds one key's intervals at a time; use ``by_key``
    where a key has too many.
    """
    kind, chunk = _kind(df, init), max(CHUNK, back)
    rows = F.array_sort(F.collect_list(F.struct("st", "et", *payload)))
    lists = df.groupBy(*keys).agg(rows.alias("_rows"))
    parts = F.transform(F.sequence(F.lit(1), F.size("_rows"), F.lit(chunk)), lambda i: F.slice("_rows", i, chunk))

    def one(own: Column, x: Column) -> Column:
        before = F.element_at(own, -1) if back == 1 else lambda n: F.element_at(own, -n)
        return F.concat(own, F.array(step(before, x).cast(kind)))

    def add(chunks: Column, part: Column) -> Column:
        outs = F.aggregate(part, F.slice(F.element_at(chunks, -1), -back, back), one)
        return F.concat(chunks, F.array(F.slice(outs, back + 1, chunk)))

    outs = F.flatten(F.aggregate(parts, F.array(F.array_repeat(init.cast(kind), back)), add))
    lists = lists.withColumn("_outs", F.slice(outs, F.lit(back + 1), F.size("_rows")))
    zipped = lists.select(*keys, F.inline(F.arrays_zip(F.col("_rows").alias("x"), F.col("_outs").alias("o"))))
    return zipped.select(*keys, "x.st", "x.et", *(f"x.{p}" for p in payload), F.col("o").alias(name))


def _kind(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("v")).schema["v"].dataType.simpleString()


def by_key(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Any recurrence: ``fn`` gets iterators of pandas frames of a key's rows in the order of time, in batches, and yields frames.

    Rows are dealt by key and sorted by Spark, so a key is never held as a whole.
    Null is a key like others.
    """

    def key(part):
        return tuple(None if x is None or x != x else x for x in part[keys].iloc[0])

    def run(frames):
        parts = (part for frame in frames for _, part in frame.groupby(keys, sort=False, dropna=False))
        for _, own in itertools.groupby(parts, key=key):
            yield from fn(own)

    return df.repartition(*keys).sortWithinPartitions(*keys, "et").mapInPandas(run, schema)
