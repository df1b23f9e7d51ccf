"""Point events and raw intervals become streams of non-overlapping ``(st, et]``."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.clock import beside
from tidemark.plans import Node
from tidemark.stream import TStream


def _by(keys: list[str], *order: str):
    return Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)


def to_intervals(df: DataFrame, time: str, keys: list[str], start: int, ties: list[str] | None = None, slab: int | None = None) -> TStream:
    """Each event holds from the key's previous event on: ``(previous time, time]``, the first from ``start``.

    Of events of a key at one time the first by ``ties`` stays; events up to
    ``start`` are dropped.  ``slab`` makes many tasks of a key (see ``beside``).
    """
    own = beside(df.filter(F.col(time) > start), keys, time, F.col(time), "_before", ties=ties, slab=slab)
    out = own.withColumn("st", F.coalesce("_before", F.lit(start).cast("long"))).withColumn("et", F.col(time)).filter("st < et").drop("_before")
    return TStream(out.drop(time) if time not in ("st", "et") else out, tuple(keys), Node("to_intervals", {"time": time, "keys": keys, "start": start}))


def fixed_intervals(df: DataFrame, time: str, keys: list[str], duration: int, ties: list[str] | None = None, slab: int | None = None) -> TStream:
    """Each event holds for ``duration`` up to its time, but not before the key's previous event; ``slab`` as for ``to_intervals``."""
    own = beside(df, keys, time, F.col(time), "_before", ties=ties, slab=slab, reach=duration)
    out = own.withColumn("st", F.greatest(F.col(time) - F.lit(duration).cast("long"), "_before")).withColumn("et", F.col(time)).filter("st < et")
    return TStream(out.drop(time, "_before"), tuple(keys), Node("fixed_intervals", {"time": time, "keys": keys, "duration": duration}))


def checked_intervals(df: DataFrame, keys: list[str], st: str = "st", et: str = "et", overlap: str = "truncate") -> TStream:
    """Intervals with given bounds.

    Empty ones are dropped.  An interval that begins before the key's earlier
    ones have ended is truncated (``overlap="truncate"``), or fails the query
    (``"fail"``).
    """
    own = df.withColumn("st", F.col(st).cast("long")).withColumn("et", F.col(et).cast("long")).filter("st < et")
    w = _by(keys, "st", "et").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max("et").over(w)
    if overlap == "fail":
        own = own.withColumn("st", F.when(F.coalesce(F.col("st") >= ended, F.lit(True)), F.col("st")).otherwise(F.raise_error(F.lit("intervals of a key overlap")).cast("long")))
    else:
        own = own.withColumn("st", F.greatest("st", ended)).filter("st < et")
    return TStream(own.drop(*({st, et} - {"st", "et"})), tuple(keys), Node("intervals", {"keys": keys, "overlap": overlap}))


def read_events(spark: SparkSession, path: str, time: str, columns: list[str], kind: str = "parquet", t0: int | None = None, t1: int | None = None) -> DataFrame:
    """The wanted columns of an event table and its time as a tick ``t``; only events in ``(t0, t1]``, where given.

    The bounds are put on the stored column, so they reach the scan.  Within
    ``(t0, t1]`` a stream of ``to_intervals`` with ``start=t0`` is whole when
    events after ``t0`` are read (up to each key's first one after ``t1``), and
    one of ``fixed_intervals`` when those up to ``t1`` plus their duration are.
    """
    from tidemark.functions import tick

    rows = spark.read.format(kind).load(path)
    stored = rows.schema[time].dataType.simpleString()
    for bound, after in ((t0, True), (t1, False)):
        if bound is not None:
            limit = F.lit(bound) if stored not in ("timestamp", "timestamp_ntz") else F.lit(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=bound)) if stored == "timestamp" else F.expr(f"TIMESTAMP_NTZ '{datetime(1970, 1, 1) + timedelta(microseconds=bound)}'")
            rows = rows.filter(F.col(time) > limit if after else F.col(time) <= limit)
    return rows.select(tick(time).alias("t"), *columns)


def write_intervals(stream: TStream, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Writes keys, bounds and payload."""
    stream.df.write.format(kind).mode(mode).partitionBy(*(partition_by or [])).save(path)
