"""Windows ``(T - size, T]`` that end on a grid of ``hop``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.align import floor_div
from tidemark.operators.clock import beside, matched


def windowed(df: DataFrame, size: int, hop: int, origin: int = 0) -> DataFrame:
    """A row for each window that an interval overlaps: its end ``w_et``, start ``w_st``, and the interval clipped to it, ``c_st`` and ``c_et``."""
    lo = floor_div(F.col("st") + F.lit(hop - origin), hop)
    hi = floor_div(F.col("et") + F.lit(size - 1 - origin), hop)
    first, last = lo * F.lit(hop) + F.lit(origin), hi * F.lit(hop) + F.lit(origin)
    out = df.withColumn("_lo", first).withColumn("_hi", last).filter("_lo <= _hi")
    out = out.withColumn("w_et", F.explode(F.sequence("_lo", "_hi", F.lit(hop).cast("long")))).drop("_lo", "_hi")
    return out.withColumn("w_st", F.col("w_et") - F.lit(size)).withColumn("c_st", F.greatest("st", "w_st")).withColumn("c_et", F.least("et", "w_et"))


def bucketed(df: DataFrame, size: int, origin: int = 0) -> DataFrame:
    """The tumbling window that holds an interval's end, for streams of points: no row is repeated."""
    bucket = F.col("et") + F.pmod(F.lit(origin) - F.col("et"), F.lit(size).cast("long"))
    return df.withColumn("w_et", bucket).withColumn("w_st", F.col("w_et") - F.lit(size)).withColumn("c_st", F.greatest("st", "w_st")).withColumn("c_et", F.col("et"))


def aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row ``(keys, st, et, aggregates)`` for each window with an interval; counted where rows are before any exchange."""
    return df.groupBy(*keys, "w_st", "w_et").agg(*(c.alias(n) for n, c in aggregates.items())).withColumnsRenamed({"w_st": "st", "w_et": "et"})


def folded(df: DataFrame, keys: list[str], payload: list[str], init: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column], name: str) -> DataFrame:
    """A fold over a window's intervals in the order of time; ``step(state, x)`` sees ``x.st``, ``x.et`` (clipped) and the payload."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("c_st").alias("st"), F.col("c_et").alias("et"), *payload)))
    lists = df.groupBy(*keys, "w_st", "w_et").agg(rows.alias("_rows"))
    return lists.select(*keys, F.col("w_st").alias("st"), F.col("w_et").alias("et"), F.aggregate("_rows", init, step, finish).alias(name))


def on_grid(df: DataFrame, keys: list[str], size: int, hop: int, t0: int, t1: int, origin: int, fill: dict[str, object]) -> DataFrame:
    """Adds a row for each window without an interval that ends in ``(t0, t1]``, for the keys that occur."""
    first = t0 + 1 + (origin - t0 - 1) % hop
    if first > t1:
        return df
    grid = df.select(*keys).distinct().withColumn("et", F.explode(F.sequence(F.lit(first), F.lit(t1), F.lit(hop)))) if keys else df.sparkSession.range(first, t1 + 1, hop).select(F.col("id").alias("et"))
    joined = grid.join(df, [*keys, "et"], "left")
    return joined.select(*keys, (F.col("et") - F.lit(size)).alias("st"), "et", *(F.coalesce(F.col(c), F.lit(fill[c]).cast(df.schema[c].dataType)).alias(c) if c in fill else F.col(c) for c in df.columns if c not in (*keys, "st", "et")))


def run_up(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], slab: int | None = None) -> DataFrame:
    """Adds running sums along ``order``, whose first column is a time; ``slab`` makes many tasks of a key, with one row for each slab carried."""
    if not slab:
        run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(run) for n, c in sums.items()})
    by = [*keys, "_slab"]
    own = df.withColumn("_slab", floor_div(F.col(order[0]), slab))
    totals = own.groupBy(*by).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums))
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = matched(own.withColumns({n: F.sum(c).over(run) for n, c in sums.items()}), carried, by, "left")
    # Null only where there was no value yet, here or before.
    return held.withColumns({n: F.coalesce(F.col(n) + F.col(f"_{n}"), n, f"_{n}") for n in sums}).drop("_slab", *(f"_{n}" for n in sums))


def sliding(df: DataFrame, keys: list[str], size: int, value: Column, slab: int | None = None) -> DataFrame:
    """Count and sum over ``(T - size, T]`` at every change point T.

    An interval is in the window for T in ``(st, et + size - 1]``, so both are
    running sums over the bounds of the extended intervals: one sort, whatever
    the size.
    """
    edges = df.select(*keys, value.alias("v"), "st", "et").select(*keys, F.inline(F.array(F.struct(F.col("st").alias("t"), F.lit(1).alias("n"), F.col("v").alias("v")), F.struct((F.col("et") + F.lit(size - 1)).alias("t"), F.lit(-1).alias("n"), (-F.col("v")).alias("v")))))
    marks = (edges.repartition(*keys) if keys and not slab else edges).groupBy(*keys, "t").agg(F.sum("n").alias("dn"), F.sum("v").alias("dv"))
    out = run_up(beside(marks, keys, "t", F.col("t"), "et", before=False, slab=slab), keys, ["t"], {"n": F.col("dn"), "sum": F.col("dv")}, slab)
    return out.select(*keys, F.col("t").alias("st"), "et", "n", "sum").filter("et IS NOT NULL AND n > 0")


def over_range(df: DataFrame, keys: list[str], size: int, aggregates: dict[str, Column]) -> DataFrame:
    """Any aggregates over the intervals that end in ``(et - size, et]``, at each interval; each looks at its whole window (``moved`` doesn't)."""
    w = Window.partitionBy(*keys).orderBy("et").rangeBetween(-(size - 1), 0)
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})


def moved(df: DataFrame, keys: list[str], size: int, value: Column, slab: int | None = None) -> DataFrame:
    """Adds ``n`` and ``sum`` over the intervals that end in ``(et - size, et]``, at each interval.

    An interval comes in at its end and goes out ``size`` later, so both are
    running sums: one sort, whatever the size.
    """
    held = F.struct(*[c for c in df.columns if c not in keys])
    edges = df.select(*keys, value.alias("_v"), "et", held.alias("_r")).select(*keys, F.inline(F.array(F.struct(F.col("et").alias("_t"), F.lit(1).alias("_k"), F.col("_v"), F.col("_r")), F.struct((F.col("et") + F.lit(size)).alias("_t"), F.lit(-1).alias("_k"), (-F.col("_v")).alias("_v"), F.lit(None).cast(df.select(held.alias("r")).schema["r"].dataType).alias("_r")))))
    out = run_up(edges, keys, ["_t", "_k"], {"n": F.col("_k"), "sum": F.col("_v")}, slab).filter("_k = 1")
    return out.select(*keys, "_r.*", "n", "sum")


def extremes(df: DataFrame, keys: list[str], size: int, value: Column) -> DataFrame:
    """Adds ``lo`` and ``hi`` over the intervals that end in ``(et - size, et]``, at each interval.

    Time is cut into blocks as long as the window, so a window is the end of one
    block and the beginning of the next: the extremes of the beginnings and ends
    of blocks, each found in one pass, meet.  Linear after the sorts, and a block
    of a key is a task.
    """
    order = Window.partitionBy(*keys, "_b")
    upto = order.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    since = order.orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select(*keys, floor_div(F.col("et") - 1, size).alias("_b"), F.col("et").alias("_t"), F.struct(*[c for c in df.columns if c not in keys]).alias("_r"), value.alias("_v"))
    own = own.withColumns({"_upto": F.struct(F.min("_v").over(upto).alias("lo"), F.max("_v").over(upto).alias("hi")), "_since": F.struct(F.min("_v").over(since).alias("lo"), F.max("_v").over(since).alias("hi"))})
    # What an interval begins, as seen from a window that ends just before it falls out.
    ends = own.select(*keys, (F.col("_b") + 1).alias("_b"), (F.col("_t") + F.lit(size)).alias("_t"), "_since")
    both = own.drop("_since", "_v").unionByName(ends, allowMissingColumns=True)
    later = order.orderBy(F.desc("_t"), F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_since", F.last("_since", ignorenulls=True).over(later)).filter(F.col("_r").isNotNull())
    return out.select(*keys, "_r.*", F.least("_upto.lo", "_since.lo").alias("lo"), F.greatest("_upto.hi", "_since.hi").alias("hi"))


def normalized(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``(v - mean) / stddev`` (population) within each row's window; null where all values are equal.

    Mean and deviation are aggregated before any exchange and joined to the rows,
    so a window with most rows is neither held nor sorted in a task.
    """
    by = [*keys, "w_et"]
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return matched(df, stats, by).withColumn(out, F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")
