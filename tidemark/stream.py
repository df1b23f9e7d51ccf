"""The stream and its operators.

A stream is a function of time, per key, with a value or none: a DataFrame of
the key columns, ``st`` and ``et`` (long, any unit), and payload columns, whose
intervals ``(st, et]`` of a key do not overlap.  Where a key has no row there is
no value.

Choices that hold for all operators: windows give a row each, also where one
event spans several; a window without an event gives no row unless asked for; a
window exists where an event overlaps it; recurrences step once per event, or
with a period once per grid time at which there is a value; a grid has an origin, and bounds are rounded down to it; numbers are
long, float or double; a division by zero is null; an overflow is an error.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align as _align
from tidemark.operators import clock as _clock
from tidemark.operators import windows as _windows
from tidemark.plans import Node

Made = Column | Callable[..., Column] | str


class Fields:
    """Columns of one input by attribute: ``e.value``."""

    def __init__(self, prefix: str = "", names: tuple[str, ...] = ()):
        self._prefix, self._names = prefix, names

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(f"{self._prefix}{name}")

    __getitem__ = __getattr__

    @property
    def present(self) -> Column:
        """Whether the input holds a value now (of an aligned input)."""
        return F.coalesce(F.col(f"{self._prefix}p"), F.lit(False))


def _made(value: Made, *inputs: Fields) -> Column:
    if callable(value) and not isinstance(value, Column):
        return value(*inputs[: len(inspect.signature(value).parameters)])
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class TStream:
    df: DataFrame
    keys: tuple[str, ...] = ()
    plan: Node = field(default_factory=lambda: Node("stream"))

    @property
    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.keys, "st", "et")]

    def _next(self, df: DataFrame, operator: str, /, *others: TStream, **arguments) -> TStream:
        return TStream(df, self.keys, Node(operator, arguments, (self.plan, *(o.plan for o in others))))

    # Row by row: no exchange, and Catalyst pushes filters and columns to the scan.

    def select(self, **columns: Made) -> TStream:
        """New payload; the intervals stay."""
        return self._next(self.df.select(*self.keys, "st", "et", *(_made(v, Fields()).alias(n) for n, v in columns.items())), "select", columns=list(columns))

    def where(self, condition: Made) -> TStream:
        """No value where the condition does not hold."""
        return self._next(self.df.filter(_made(condition, Fields())), "where")

    def shift(self, by: int) -> TStream:
        """The value of ``by`` ago."""
        return self._next(self.df.withColumns({"st": F.col("st") + F.lit(by), "et": F.col("et") + F.lit(by)}), "shift", by=by)

    def clip(self, t0: int, t1: int) -> TStream:
        """The stream within ``(t0, t1]``."""
        own = self.df.filter((F.col("et") > t0) & (F.col("st") < t1))
        return self._next(own.withColumns({"st": F.greatest("st", F.lit(t0).cast("long")), "et": F.least("et", F.lit(t1).cast("long"))}), "clip", t0=t0, t1=t1)

    def partitioned(self) -> TStream:
        """Dealt by key once; the operators after it then need no exchange of their own."""
        return self._next(self.df.repartition(*self.keys), "partitioned") if self.keys else self

    def slab_for(self, rows: int = 1_000_000) -> int | None:
        """A width for ``slab=`` that gives the key with most intervals about ``rows`` of them in each; None where no key has more.

        Runs an aggregate; takes that key's intervals as evenly spread.
        """
        counts = self.df.groupBy(*self.keys).agg(F.count("*").alias("n"), (F.max("et") - F.min("st")).alias("span"))
        most = counts.agg(F.max(F.struct("n", "span")).alias("m")).first()["m"]
        return None if most is None or most["n"] <= rows else max(1, most["span"] * rows // most["n"])

    # Joins.

    def align(self, condition: Callable[..., Column], columns: dict[str, Made], *others: TStream, offsets: tuple[int, ...] | None = None, period: int = 1, origin: int = 0, slab: int | None = None) -> TStream:
        """The temporal map: looks up all inputs, gives a value where ``condition`` holds.

        Functions get one ``Fields`` per input; ``x.present`` says whether it
        holds a value.  ``offsets`` (at most 0) looks inputs up in the past, and
        ``period`` over 1 samples on a grid.
        """
        streams = (self, *others)
        offsets = offsets or (0,) * len(streams)
        names = [f"_{i}" for i in range(len(streams))]
        inputs = {n: (s.df, s.payload, o) for n, s, o in zip(names, streams, offsets, strict=True)}
        fields = [Fields(f"{n}.", tuple(s.payload)) for n, s in zip(names, streams, strict=True)]
        out = _align.snap(_align.align(inputs, list(self.keys), slab), period, origin).filter(condition(*fields))
        return self._next(out.select(*self.keys, "st", "et", *(_made(v, *fields).alias(n) for n, v in columns.items())), "align", *others, offsets=offsets, period=period)

    def join(self, other: TStream, how: str = "inner", slab: int | None = None, on: Callable[..., Column] | None = None, **columns: Made) -> TStream:
        """Join on time: inner, left, right, outer, semi or anti; ``on`` adds a condition on both values."""
        held = {"inner": lambda a, b: a.present & b.present, "semi": lambda a, b: a.present & b.present, "left": lambda a, b: a.present, "right": lambda a, b: b.present, "outer": lambda a, b: a.present | b.present, "anti": lambda a, b: a.present & ~b.present}[how]
        out = self.align((lambda a, b: held(a, b) & F.coalesce(on(a, b), F.lit(False))) if on else held, columns, other, slab=slab)
        return TStream(out.df, self.keys, Node(f"{how} join", {"columns": list(columns)}, out.plan.inputs))

    def lagged(self, by: int, **columns: Made) -> TStream:
        """Now and ``by`` ago, where both hold a value: functions get ``(now, before)``."""
        return self.align(lambda a, b: a.present & b.present, columns, self, offsets=(0, -by))

    def sample(self, period: int, origin: int = 0) -> TStream:
        """The value at grid times, each for the time up to it; a value that holds at several is one interval."""
        return self._next(_align.snap(self.df, period, origin), "sample", period=period, origin=origin)

    def chop(self, period: int, origin: int = 0) -> TStream:
        """The value at grid times, an interval for each."""
        out = _clock.ticks(self.df, period, origin, "_t").withColumns({"st": F.col("_t") - F.lit(period), "et": F.col("_t")}).drop("_t")
        return self._next(out, "chop", period=period, origin=origin)

    def asof(self, points: DataFrame, time: str, prefix: str = "", slab: int | None = None) -> DataFrame:
        """``points`` with the payload that holds at their time, null where none does; one exchange and sort, no range join.

        With ``slab`` each slab of time is a task of its own, and what holds at its start is carried there through one row for each slab.
        """
        names = {c: f"{prefix}{c}" for c in self.payload}
        held = F.struct(F.lit(True).alias("p"), *self.payload)
        gone = F.struct(F.lit(False).alias("p"), *(F.lit(None).cast(self.df.schema[c].dataType).alias(c) for c in self.payload))
        edges = self.df.select(*self.keys, F.inline(F.array(F.struct(F.col("et").alias("_t"), F.lit(1).alias("_k"), gone.alias("_s")), F.struct(F.col("st").alias("_t"), F.lit(2).alias("_k"), held.alias("_s")))))
        # A point at t sees what began before t, so it comes before the bounds at t.
        probes = points.select(*self.keys, F.col(time).cast("long").alias("_t"), F.lit(0).alias("_k"), F.struct(*[c for c in points.columns if c not in self.keys]).alias("_r"))
        both = probes.unionByName(edges, allowMissingColumns=True)
        by, window = list(self.keys), _clock.Window
        if slab:
            by.append("_slab")
            both = both.withColumn("_slab", _align.floor_div(F.col("_t"), slab))
        out = both.withColumn("_s", F.last("_s", ignorenulls=True).over(window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(window.unboundedPreceding, 0))).filter("_k = 0")
        if slab:
            ends = both.groupBy(*by).agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct("_t", "_k"))).alias("_c"))
            ends = ends.withColumn("_c", F.last("_c", ignorenulls=True).over(window.partitionBy(*self.keys).orderBy("_slab").rowsBetween(window.unboundedPreceding, -1)))
            out = _clock.matched(out, ends, by, "left").withColumn("_s", F.coalesce("_s", "_c"))
        return out.select(*self.keys, "_r.*", *(F.col(f"_s.{c}").alias(n) for c, n in names.items()))

    # Windows.

    def slice(self, a: int, b: int, hop: int, origin: int = 0) -> Windowed:
        """The windows ``(T + a, T + b]`` of the times ``T`` on a grid of ``hop``, also of the future; results are for ``(T - b + a, T]``."""
        if a >= b:
            raise ValueError("a slice ends after it begins")
        return replace(self.shift(-b).window(b - a, hop, origin), plan=Node("slice", {"a": a, "b": b, "hop": hop}, (self.plan,)))

    def window(self, size: int, hop: int | None = None, origin: int = 0, by: str = "overlap") -> Windowed:
        """Windows ``(T - size, T]`` every ``hop``; ``by="end"`` puts points into the tumbling window of their time."""
        hop = hop or size
        if by == "end" and hop != size:
            raise ValueError("windows by end tumble")
        rows = _windows.bucketed(self.df, size, origin) if by == "end" else _windows.windowed(self.df, size, hop, origin)
        return Windowed(self, rows, size, hop, origin, Node("window", {"size": size, "hop": hop, "by": by}, (self.plan,)))

    def sliding(self, size: int, value: Made, slab: int | None = None) -> TStream:
        """``n``, ``sum`` over ``(T - size, T]`` at every change point."""
        return self._next(_windows.sliding(self.df, list(self.keys), size, _made(value, Fields()), slab), "sliding", size=size)

    def moving_sum(self, size: int, value: Made, slab: int | None = None) -> TStream:
        """The payload with ``n`` and ``sum`` over what ended in the last ``size``, at every interval; one sort, whatever the size."""
        return self._next(_windows.moved(self.df, list(self.keys), size, _made(value, Fields()), slab), "moving_sum", size=size)

    def moving_extremes(self, size: int, value: Made) -> TStream:
        """The payload with ``lo`` and ``hi`` over what ended in the last ``size``, at every interval; linear after the sorts."""
        return self._next(_windows.extremes(self.df, list(self.keys), size, _made(value, Fields())), "moving_extremes", size=size)

    def moving(self, size: int, **aggregates: Made) -> TStream:
        """Any aggregates over what ended in the last ``size``, at every interval; each looks at its whole window."""
        return self._next(_windows.over_range(self.df, list(self.keys), size, {n: _made(v, Fields()) for n, v in aggregates.items()}), "moving", size=size)

    # Clock and recurrences.

    def beat(self, period: int, origin: int = 0, name: str = "tick") -> TStream:
        """A clock where the stream holds a value: the time itself, at each grid time."""
        out = _clock.ticks(self.df, period, origin, name)
        return self._next(out.select(*self.keys, (F.col(name) - F.lit(period)).alias("st"), F.col(name).alias("et"), name), "beat", period=period, origin=origin)

    def pair(self, value: str, slab: int | None = None) -> TStream:
        return self._next(_clock.paired(self.df, list(self.keys), value, slab), "pair", value=value)

    def interpolate(self, period: int, origin: int = 0, value: str = "value") -> TStream:
        """Of pairs: linear values on a grid."""
        return self._next(_clock.interpolated(self.df, list(self.keys), period, origin, value), "interpolate", period=period)

    def resample(self, period: int, value: str, origin: int = 0) -> TStream:
        """Linear resampling of the samples at the intervals' ends."""
        return self.pair(value).interpolate(period, origin, value)

    def fill(self, until: int | None = None, slab: int | None = None) -> TStream:
        return self._next(_clock.filled(self.df, list(self.keys), self.payload, until, slab), "fill", until=until)

    def running(self, **aggregates: Made) -> TStream:
        return self._next(_clock.running(self.df, list(self.keys), {n: _made(v, Fields()) for n, v in aggregates.items()}), "running", columns=list(aggregates))

    def recurrence(self, init: Column, step: Callable[..., Column], name: str, back: int = 1, period: int | None = None, origin: int = 0) -> TStream:
        """``step(before, x)`` at each event, or with ``period`` at each grid time at which there is a value; over a gap the last out stays.

        ``before`` is the previous out, or with ``back`` over 1 a function: ``before(n)`` is the out of ``n <= back`` steps ago.
        """
        rows = self.chop(period, origin).df if period else self.df
        return self._next(_clock.recurrence(rows, list(self.keys), self.payload, init, step, name, back), "recurrence", name=name, back=back, period=period)

    def by_key(self, fn, schema: str) -> DataFrame:
        return _clock.by_key(self.df, list(self.keys), fn, schema)

    # Extension points and plans.

    def apply(self, operator: Callable[..., TStream], *arguments, **named) -> TStream:
        """A macro operator: any function from a stream to a stream."""
        return operator(self, *arguments, **named)

    def call(self, name: str, function, *columns: str) -> TStream:
        """A user function (a pandas or Arrow UDF) of payload columns."""
        return self._next(self.df.withColumn(name, function(*columns)), "call", name=name)

    def table(self, function, *columns: str) -> TStream:
        """A user table function (``F.udtf``) of payload columns: a row for each that it yields, its columns beside the payload."""
        return self._next(self.df.lateralJoin(function(*(F.col(c).outer() for c in columns))), "table", columns=list(columns))

    def tree(self) -> str:
        return self.plan.render()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


@dataclass(frozen=True)
class Windowed:
    """A stream's rows by window."""

    stream: TStream
    rows: DataFrame
    size: int
    hop: int
    origin: int
    plan: Node

    def _out(self, df: DataFrame, name: str) -> TStream:
        return TStream(df, self.stream.keys, Node(name, {}, (self.plan,)))

    def agg(self, **aggregates: Made) -> TStream:
        """Spark aggregates; ``c_st`` and ``c_et`` are the bounds within the window."""
        return self._out(_windows.aggregate(self.rows, list(self.stream.keys), {n: _made(v, Fields()) for n, v in aggregates.items()}), "aggregate")

    def agg_all(self, t0: int, t1: int, fill: dict[str, object] | None = None, **aggregates: Made) -> TStream:
        """As ``agg``, and a row for every window of a key that ends in ``(t0, t1]``, with an event or not."""
        out = self.agg(**aggregates)
        return self._out(_windows.on_grid(out.df, list(self.stream.keys), self.size, self.hop, t0, t1, self.origin, fill or {}), "aggregate with empty windows")

    def reduce(self, name: str, init: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda s: s) -> TStream:
        """Any fold over a window's events in the order of time."""
        return self._out(_windows.folded(self.rows, list(self.stream.keys), self.stream.payload, init, step, finish, name), "reduce")

    def per_window(self, operator: Callable[[TStream], TStream]) -> TStream:
        """A stream-valued operator: ``operator`` on each window's events, clipped to it, as a stream; its end ``w_et`` becomes a key."""
        keys = (*self.stream.keys, "w_et")
        own = self.rows.select(*keys, F.col("c_st").alias("st"), F.col("c_et").alias("et"), *self.stream.payload)
        out = operator(TStream(own, keys, Node("window's events", {}, (self.plan,))))
        return TStream(out.df, keys, Node("per_window", {}, (out.plan,)))

    def time_weighted(self, value: str, name: str) -> TStream:
        """Mean weighted with the time that a value holds in the window."""
        held = F.col("c_et") - F.col("c_st")
        return self.agg(**{name: F.try_divide(F.sum(F.col(value) * held), F.sum(held).cast("double"))})

    def normalize(self, value: str, name: str) -> TStream:
        """Each event with its z-score in the window."""
        out = _windows.normalized(self.rows, list(self.stream.keys), value, name)
        return self._out(out.drop("w_st", "w_et", "c_st", "c_et"), "normalize")
