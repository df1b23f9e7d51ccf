"""Align and snap: the temporal map over any number of inputs.

Every input's interval bounds, moved by the input's offset, cut time into
segments on which all lookups are constant.  One exchange by key and one sort
serve all inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_div(a: Column, b: int) -> Column:
    """Quotient of longs, downwards."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def align(inputs: dict[str, tuple[DataFrame, list[str], int]], keys: list[str], slab: int | None = None) -> DataFrame:
    """Segments ``(keys, st, et)`` with a struct column per input: ``p`` (present) and its payload fields.

    ``inputs`` maps a name to a frame, its payload columns and its offset (at
    most 0): the input is looked up at now plus the offset.  With ``slab``, time
    is cut into slabs of that width which are aligned apart from each other, so
    that one hot key, or a stream without keys, is many tasks; segments then end
    at slab bounds too.
    """
    edges = []
    for name, (df, payload, offset) in inputs.items():
        if offset > 0:
            raise ValueError("lookups are at now or before: offset <= 0")
        st, et = F.col("st") - F.lit(offset), F.col("et") - F.lit(offset)
        own = df.select(*keys, st.alias("st"), et.alias("et"), *payload)
        by = list(keys)
        if slab:
            first, last = floor_div(F.col("st"), slab), floor_div(F.col("et") - 1, slab)
            own = own.withColumn("_slab", F.explode(F.sequence(first, last)))
            own = own.withColumn("st", F.greatest("st", F.col("_slab") * slab)).withColumn("et", F.least("et", (F.col("_slab") + 1) * slab))
            by.append("_slab")
        kept = F.struct(F.lit(True).alias("p"), *payload)
        gone = F.struct(F.lit(False).alias("p"), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in payload))
        edges.append(own.select(*by, F.inline(F.array(F.struct(F.col("st").alias("t"), kept.alias(name)), F.struct(F.col("et").alias("t"), gone.alias(name))))))
    by = [*keys, "_slab"] if slab else list(keys)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), edges)
    if by:
        both = both.repartition(*by)
    # At one time an interval that begins beats one that ends.
    marks = both.groupBy(*by, "t").agg(*(F.max_by(F.col(n), F.col(f"{n}.p")).alias(n) for n in inputs))
    w = Window.partitionBy(*by).orderBy("t")
    held = marks.select(*keys, F.col("t").alias("st"), F.lead("t").over(w).alias("et"), *(F.last(n, ignorenulls=True).over(w).alias(n) for n in inputs))
    return held.filter(F.col("et").isNotNull())


def present(name: str) -> Column:
    """Whether the aligned input holds a value."""
    return F.coalesce(F.col(f"{name}.p"), F.lit(False))


def floor_grid(t: Column, period: int, origin: int = 0) -> Column:
    """Last grid time up to ``t``."""
    return t - F.pmod(t - F.lit(origin), F.lit(period).cast("long"))


def snap(df: DataFrame, period: int, origin: int = 0) -> DataFrame:
    """Bounds moved down to the grid; what then is empty held at no grid time and goes."""
    if period == 1:
        return df
    return df.withColumn("st", floor_grid(F.col("st"), period, origin)).withColumn("et", floor_grid(F.col("et"), period, origin)).filter("st < et")
