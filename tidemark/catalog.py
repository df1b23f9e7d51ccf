"""The registered queries of the temporal engine, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import functions as fn
from tidemark.sources import checked_intervals, fixed_intervals, read_events, to_intervals
from tidemark.stream import TStream

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: The day before the first event.
START = 1_703_980_800_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# Streams of the events, and the same in SQL.


def events(spark: SparkSession, sf_dir: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
    df = read_events(spark, f"{sf_dir}/events.parquet", "ts", ["event_id", "user_id", "event_type", "value"], t0=t0, t1=t1)
    return df.withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def users(spark: SparkSession, sf_dir: str, t0: int | None = None) -> TStream:
    """Per user: each event holds since the one before, or since ``t0``; then earlier events are not read."""
    return to_intervals(events(spark, sf_dir, t0), "t", ["user_id"], t0 or START, ["event_id"])


def kind(spark: SparkSession, sf_dir: str, event_type: str, hours: int = 72, keys=("user_id",), slab: int | None = None, t0: int | None = None, t1: int | None = None) -> TStream:
    """Events of a type, each for some hours up to it: a stream with gaps."""
    own = events(spark, sf_dir, t0, t1).filter(F.col("event_type") == event_type).select("t", "event_id", "user_id", "cents")
    return fixed_intervals(own if keys else own.drop("user_id"), "t", list(keys), hours * HOUR, ["event_id"], slab)


def uniform(spark: SparkSession, sf_dir: str, step: int) -> TStream:
    """Per user: the events in order, one every ``step``."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long")
    rows = events(spark, sf_dir).select("user_id", "cents", (n * step).alias("et")).withColumn("st", F.col("et") - step)
    return TStream(rows, ("user_id",))


EV = "ev AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
IV = f"{EV}, iv AS (SELECT * FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), {START}) AS st, t AS et FROM ev WHERE t > {START}) WHERE st < et)"


def _kind(name: str, event_type: str, hours: int = 72, keyed: bool = True) -> str:
    by = "PARTITION BY user_id " if keyed else ""
    return f"{name} AS (SELECT * FROM (SELECT event_id, user_id, cents, greatest(t - {hours * HOUR}, coalesce(lag(t) OVER ({by}ORDER BY t, event_id), t - {hours * HOUR})) AS st, t AS et FROM ev WHERE event_type = '{event_type}') WHERE st < et)"


def _uniform(step: int) -> str:
    return f"{EV}, un AS (SELECT user_id, cents, n * {step} - {step} AS st, n * {step} AS et FROM (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev))"


def _windows(source: str, size: int, hop: int) -> str:
    """Rows of ``source`` by the windows they overlap."""
    return f"wd AS (SELECT *, w_et - {size} AS w_st, greatest(st, w_et - {size}) AS c_st, least(et, w_et) AS c_et FROM (SELECT *, unnest(range((st // {hop} + 1) * {hop}, ((et + {size - 1}) // {hop}) * {hop} + 1, {hop})) AS w_et FROM {source}))"


# Sources.


@query(f"WITH {IV} SELECT user_id, st, et, event_id, cents FROM iv")
def to_intervals_lag(spark, sf_dir):
    return users(spark, sf_dir).df.select("user_id", "st", "et", "event_id", "cents")


@query(f"WITH {EV}, {_kind('a', 'click')} SELECT user_id, st, et, event_id, cents FROM a")
def to_intervals_fixed(spark, sf_dir):
    return kind(spark, sf_dir, "click").df.select("user_id", "st", "et", "event_id", "cents")


@query(f"WITH {EV}, r AS (SELECT user_id, event_id, t AS st, t + {10 * HOUR} AS et FROM ev), m AS (SELECT *, max(et) OVER (PARTITION BY user_id ORDER BY st, et ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r) SELECT user_id, event_id, greatest(st, coalesce(e, st)) AS st, et FROM m WHERE greatest(st, coalesce(e, st)) < et")
def intervals_truncated(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("a"), (F.col("t") + 10 * HOUR).alias("b"))
    return checked_intervals(rows, ["user_id"], "a", "b").df.select("user_id", "event_id", "st", "et")


# Scalars: one query each, with an integer and a float operand where both exist.

SCALARS: dict[str, dict[str, tuple[Callable, str]]] = {
    "add": {"i": (lambda e: e.cents + 10, "cents + 10"), "f": (lambda e: e.value + 5.0, "value + 5.0::DOUBLE")},
    "sub": {"i": (lambda e: e.cents - 10, "cents - 10"), "f": (lambda e: e.value - 15.0, "value - 15.0::DOUBLE")},
    "mul": {"i": (lambda e: e.cents * 10, "cents * 10"), "f": (lambda e: e.value * 10.0, "value * 10.0::DOUBLE")},
    "div": {"i": (lambda e: fn.int_div(e.cents - 20000, 10), "(cents - 20000) // 10"), "f": (lambda e: fn.safe_div(e.value, 10.0), "value / 10.0::DOUBLE"), "z": (lambda e: fn.safe_div(e.value, e.value - e.value), "CAST(NULL AS DOUBLE)")},
    "mod": {"i": (lambda e: fn.int_mod(e.cents - 20000, 7), "(cents - 20000) % 7")},
    "max": {"i": (lambda e: fn.larger(e.cents, 1000), "greatest(cents, 1000)"), "f": (lambda e: fn.larger(e.value, 10.0), "greatest(value, 10.0::DOUBLE)")},
    "min": {"i": (lambda e: fn.smaller(e.cents, 1000), "least(cents, 1000)"), "f": (lambda e: fn.smaller(e.value, 10.0), "least(value, 10.0::DOUBLE)")},
    "neg": {"i": (lambda e: -e.cents, "-cents"), "f": (lambda e: -e.value, "-value")},
    "abs": {"i": (lambda e: fn.absolute(e.cents - 20000), "abs(cents - 20000)"), "f": (lambda e: fn.absolute(e.value - 100.0), "abs(value - 100.0::DOUBLE)")},
    "sqrt": {"f": (lambda e: fn.root(e.value), "sqrt(value)")},
    "pow": {"f": (lambda e: F.round(fn.power(e.value, 2.0), 4), "round(pow(value, 2.0::DOUBLE), 4)")},
    "ceil": {"f": (lambda e: fn.ceiling(e.value), "ceil(value)")},
    "floor": {"f": (lambda e: fn.floored(e.value), "floor(value)")},
    "lt": {"b": (lambda e: e.cents < 5000, "cents < 5000")},
    "lte": {"b": (lambda e: e.cents <= 5000, "cents <= 5000")},
    "gt": {"b": (lambda e: e.cents > 5000, "cents > 5000")},
    "gte": {"b": (lambda e: e.cents >= 5000, "cents >= 5000")},
    "eq": {"b": (lambda e: e.cents % 2 == 0, "cents % 2 = 0"), "ne": (lambda e: ~(e.cents % 2 == 0), "NOT (cents % 2 = 0)")},
    "not": {"b": (lambda e: ~(e.cents > 5000), "NOT cents > 5000")},
    "and": {"b": (lambda e: (e.cents > 5000) & (e.value < 100.0), "cents > 5000 AND value < 100")},
    "or": {"b": (lambda e: (e.cents > 9000) | (e.value < 10.0), "cents > 9000 OR value < 10")},
    "const": {"i": (lambda e: fn.constant(7, "long"), "7::BIGINT"), "f": (lambda e: fn.constant(0.5, "double"), "0.5::DOUBLE"), "b": (lambda e: fn.constant(True, "boolean"), "TRUE")},
    "cast_int_to_float": {"f": (lambda e: fn.to_type(e.cents, "double"), "cents::DOUBLE")},
    "cast_float_to_int": {"i": (lambda e: fn.to_type(e.value - 100.0, "int"), "trunc(value - 100.0::DOUBLE)::INTEGER")},
    "cast_float_to_long": {"i": (lambda e: fn.to_type(e.value, "long"), "trunc(value)::BIGINT")},
    "cast_byte_to_int": {"i": (lambda e: fn.to_type(fn.to_type(e.cents % 128, "byte"), "int"), "(cents % 128)::TINYINT::INTEGER")},
    "cast_unsigned": {"i": (lambda e: fn.to_type(fn.to_type(e.cents % 65536, "int"), "double"), "(cents % 65536)::USMALLINT::DOUBLE")},
    "cast_float32": {"f": (lambda e: fn.to_type(e.value, "float"), "value::FLOAT"), "g": (lambda e: fn.to_type(e.value, "float") + fn.constant(5, "float"), "value::FLOAT + 5::FLOAT"), "i": (lambda e: fn.to_type(fn.to_type(e.value, "float"), "int"), "trunc(value::FLOAT)::INTEGER")},
    "cast_wrapping": {"i": (lambda e: fn.to_type(e.cents - 20000, "uint"), "((cents - 20000) & 4294967295)::UINTEGER::BIGINT"), "s": (lambda e: fn.to_type((e.cents - 20000) * 7, "ushort"), "(((cents - 20000) * 7) & 65535)::USMALLINT::INTEGER"), "b": (lambda e: fn.to_type(e.cents, "ubyte"), "(cents & 255)::UTINYINT::SMALLINT"), "f": (lambda e: fn.to_type(fn.to_type(e.value, "float"), "uint"), "trunc(value::FLOAT)::UINTEGER::BIGINT")},
    "case": {"i": (lambda e: fn.either(e.cents > 5000, e.cents, -e.cents), "CASE WHEN cents > 5000 THEN cents ELSE -cents END")},
    "exists": {"b": (lambda e: e.cents.isNotNull(), "cents IS NOT NULL")},
    "struct": {"i": (lambda e: fn.field(fn.new(e.cents, e.value), 0), "cents"), "f": (lambda e: fn.field(fn.field(fn.new(fn.new(e.value), e.cents), 0), 0), "value")},
}


def _scalar(name: str, columns: dict[str, tuple[Callable, str]]) -> None:
    made = {c: f for c, (f, _) in columns.items()}
    sql = ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items())
    query(f"WITH {IV} SELECT user_id, st, et, {sql} FROM iv", f"select_{name}")(lambda spark, sf_dir: users(spark, sf_dir).select(**made).df)


for _name, _columns in SCALARS.items():
    _scalar(_name, _columns)


@query(f"WITH {IV} SELECT user_id, st, et, (cents + 10) * 2 AS twice, (cents + 10) * 2 - cents AS rest FROM iv")
def select_let(spark, sf_dir):
    """Bindings that later ones use."""
    return users(spark, sf_dir).select(cents="cents", a=lambda e: e.cents + 10).select(cents="cents", twice=lambda e: e.a * 2).select(twice="twice", rest=lambda e: e.twice - e.cents).df


@query(f"WITH {IV} SELECT user_id, st, et, cents FROM iv WHERE cents > 5000 AND event_type <> 'view'")
def where_filter(spark, sf_dir):
    return users(spark, sf_dir).where(lambda e: (e.cents > 5000) & (e.event_type != "view")).select(cents="cents").df


@query(f"WITH {IV} SELECT user_id, st + {HOUR} AS st, et + {HOUR} AS et, cents FROM iv")
def shift_1h(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").shift(HOUR).df


@query(f"WITH {IV} SELECT user_id, greatest(st, {START + 5 * DAY}) AS st, least(et, {START + 9 * DAY}) AS et, cents FROM iv WHERE et > {START + 5 * DAY} AND st < {START + 9 * DAY}")
def clip_days(spark, sf_dir):
    """Some days: what an event before them began holds from their start on, so such events are not read."""
    return users(spark, sf_dir, START + 5 * DAY).select(cents="cents").clip(START + 5 * DAY, START + 9 * DAY).df


@query(f"WITH {EV}, {_kind('a', 'click')} SELECT user_id, greatest(st, {START + 5 * DAY}) AS st, least(et, {START + 9 * DAY}) AS et, cents FROM a WHERE et > {START + 5 * DAY} AND st < {START + 9 * DAY}")
def clip_at_the_scan(spark, sf_dir):
    """Some days of a stream of intervals of 72 hours: only events up to their end and 72 hours more are read."""
    t0, t1 = START + 5 * DAY, START + 9 * DAY
    return kind(spark, sf_dir, "click", t0=t0, t1=t1 + 72 * HOUR).select(cents="cents").clip(t0, t1).df


@query(f"WITH {IV} SELECT user_id, st, et, cents + 7 AS v FROM iv WHERE (cents + 7) % 2 = 0")
def macro_operator(spark, sf_dir):
    """An operator that is a function of a stream."""

    def even(stream: TStream, by: int) -> TStream:
        return stream.select(v=lambda e: e.cents + by).where(lambda e: e.v % 2 == 0)

    return users(spark, sf_dir).apply(even, 7).df


@query(f"WITH {IV} SELECT user_id, st, et, cents, part, cents % (part + 2) AS rest FROM iv, (VALUES (0), (1), (2)) p(part) WHERE part <= cents % 3")
def table_function(spark, sf_dir):
    """A user table function: from no row to three for each event."""

    @F.udtf(returnType="part int, rest long")
    class Parts:
        def eval(self, cents: int):
            for part in range(cents % 3 + 1):
                yield part, cents % (part + 2)

    return users(spark, sf_dir).select(cents="cents").table(Parts, "cents").df


@query("SELECT * FROM (VALUES (0, 'aggregate()'), (1, '  window(size=86400000000, hop=86400000000, by=overlap)'), (2, '    where() [row by row]'), (3, '      inner join(columns=[''d''])'), (4, '        stream()'), (5, '        stream()')) AS t(line, operator)")
def operator_tree(spark, sf_dir):
    """What a query is made of, as ``tree`` tells it."""
    a, b = (TStream(s.df, s.keys) for s in _pair(spark, sf_dir))
    tree = a.join(b, d=lambda l, r: l.cents - r.cents).where(lambda e: e.d > 0).window(DAY).agg(n=F.count("*")).tree()
    return spark.createDataFrame(list(enumerate(tree.splitlines())), "line int, operator string")


@query(f"WITH {IV} SELECT user_id, st, et, event_id, cents FROM iv")
def sink_round_trip(spark, sf_dir):
    """A stream written to files and read again."""
    import uuid

    from tidemark.sources import write_intervals
    from tidemark.streaming.run import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/tidemark/sink-{uuid.uuid4().hex}"
    stream = users(spark, sf_dir).select(event_id="event_id", cents="cents")
    write_intervals(stream, path)
    return checked_intervals(spark.read.parquet(path), ["user_id"]).df.select("user_id", "st", "et", "event_id", "cents")


@query(f"WITH {IV} SELECT user_id, st, et, cents, cents * 2 + 1 AS y FROM iv")
def call_udf(spark, sf_dir):
    """A user function: Arrow batches, not rows."""

    @F.pandas_udf(T.LongType())
    def odd(s):
        return s * 2 + 1

    return users(spark, sf_dir).select(cents="cents").call("y", odd, "cents").df


# Joins on time.


def _aligned(*names: str) -> str:
    """Segments with the columns of each stream, null where it has no value."""
    times = " UNION ".join(f"SELECT user_id, st AS t FROM {n} UNION SELECT user_id, et FROM {n}" for n in names)
    columns = ", ".join(f"{n}.event_id AS {n}_id, {n}.cents AS {n}_c" for n in names)
    joins = " ".join(f"LEFT JOIN {n} ON {n}.user_id = seg.user_id AND {n}.st <= seg.st AND {n}.et >= seg.et" for n in names)
    return f"seg AS (SELECT user_id, t AS st, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS et FROM ({times})), al AS (SELECT seg.*, {columns} FROM seg {joins} WHERE seg.et IS NOT NULL)"


TWO = f"WITH {EV}, {_kind('a', 'click')}, {_kind('b', 'view')}, {_aligned('a', 'b')}"
CUT = "WHERE a_id IS NOT NULL"


def _pair(spark, sf_dir):
    return kind(spark, sf_dir, "click"), kind(spark, sf_dir, "view")


@query(f"{TWO} SELECT user_id, st, et, a_c - b_c AS d FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL")
def join_inner(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, d=lambda l, r: l.cents - r.cents).df


@query(f"{TWO} SELECT user_id, st, et, a_c, coalesce(b_c, -1) AS b_c FROM al {CUT}")
def join_left(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, "left", a_c=lambda l, r: l.cents, b_c=lambda l, r: fn.either(r.present, r.cents, -1)).df


@query(f"{TWO} SELECT user_id, st, et, a_c, b_c FROM al WHERE b_id IS NOT NULL")
def join_right(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, "right", a_c=lambda l, r: F.when(l.present, l.cents), b_c=lambda l, r: r.cents).df


@query(f"{TWO} SELECT user_id, st, et, a_c, b_c FROM al WHERE a_id IS NOT NULL OR b_id IS NOT NULL")
def join_outer(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, "outer", a_c=lambda l, r: F.when(l.present, l.cents), b_c=lambda l, r: F.when(r.present, r.cents)).df


@query(f"{TWO} SELECT user_id, st, et, a_c FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL")
def join_semi(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, "semi", a_c=lambda l, r: l.cents).df


@query(f"{TWO} SELECT user_id, st, et, a_c FROM al WHERE a_id IS NOT NULL AND b_id IS NULL")
def join_anti(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, "anti", a_c=lambda l, r: l.cents).df


@query(f"{TWO} SELECT user_id, st, et, a_c, b_c FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND a_c < b_c")
def join_theta(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.join(b, on=lambda l, r: l.cents < r.cents, a_c=lambda l, r: l.cents, b_c=lambda l, r: r.cents).df


@query(f"WITH {EV}, {_kind('a', 'click')}, {_kind('b', 'view')}, {_kind('c', 'purchase')}, {_aligned('a', 'b', 'c')} SELECT user_id, st, et, a_c + b_c + c_c AS s FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND c_id IS NOT NULL")
def join_three_way(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    c = kind(spark, sf_dir, "purchase")
    return a.align(lambda x, y, z: x.present & y.present & z.present, {"s": lambda x, y, z: x.cents + y.cents + z.cents}, b, c).df


@query(f"{TWO} SELECT user_id, st, et, coalesce(a_c, b_c) AS v FROM al WHERE a_id IS NOT NULL OR b_id IS NOT NULL")
def merge_streams(spark, sf_dir):
    """Temporal union: the first stream's value, else the second's."""
    a, b = _pair(spark, sf_dir)
    return a.align(lambda x, y: x.present | y.present, {"v": lambda x, y: fn.either(x.present, x.cents, y.cents)}, b).df


@query(f"WITH {EV}, {_kind('a', 'click')}, b AS (SELECT event_id, user_id, cents, st + {6 * HOUR} AS st, et + {6 * HOUR} AS et FROM a), {_aligned('a', 'b')} SELECT user_id, st, et, a_c - b_c AS d FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL")
def lag_delta(spark, sf_dir):
    return kind(spark, sf_dir, "click").lagged(6 * HOUR, d=lambda now, before: now.cents - before.cents).df


@query(f"{TWO}, sn AS (SELECT user_id, st - st % {12 * HOUR} AS st, et - et % {12 * HOUR} AS et, a_c - b_c AS d FROM al WHERE a_id IS NOT NULL AND b_id IS NOT NULL) SELECT * FROM sn WHERE st < et")
def align_sampled(spark, sf_dir):
    """A join that is evaluated at grid times."""
    a, b = _pair(spark, sf_dir)
    return a.align(lambda x, y: x.present & y.present, {"d": lambda x, y: x.cents - y.cents}, b, period=12 * HOUR).df


@query(f"WITH {EV}, {_kind('a', 'click', 1, False)}, {_kind('b', 'view', 1, False)} SELECT CAST(sum(least(a.et, b.et) - greatest(a.st, b.st)) AS BIGINT) AS both_us, CAST(sum((least(a.et, b.et) - greatest(a.st, b.st)) * a.cents) AS BIGINT) AS weighted FROM a JOIN b ON a.st < b.et AND b.st < a.et")
def join_unkeyed_slabs(spark, sf_dir):
    """Streams without keys: aligned by day, each day a task; the time both hold."""
    a, b = (kind(spark, sf_dir, k, 1, (), DAY) for k in ("click", "view"))
    both = a.join(b, slab=DAY, cents=lambda l, r: l.cents).df
    held = F.col("et") - F.col("st")
    return both.agg(F.sum(held).alias("both_us"), F.sum(held * F.col("cents")).alias("weighted"))


@query(f"WITH {IV} SELECT * FROM (SELECT user_id, st - st % {DAY} AS st, et - et % {DAY} AS et, cents FROM iv) WHERE st < et")
def sample_grid(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").sample(DAY).df


@query(f"WITH {IV} SELECT user_id, t2 - {DAY} AS st, t2 AS et, cents FROM (SELECT user_id, cents, unnest(range((st // {DAY} + 1) * {DAY}, et + 1, {DAY})) AS t2 FROM iv)")
def chop_grid(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").chop(DAY).df


@query(f"WITH {EV}, {_kind('b', 'view')} SELECT p.user_id, p.event_id, p.t, b.event_id AS v_event_id, b.cents AS v_cents FROM ev p LEFT JOIN b ON b.user_id = p.user_id AND b.st < p.t AND p.t <= b.et WHERE p.event_type = 'purchase'")
def asof_lookup(spark, sf_dir):
    points = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    return kind(spark, sf_dir, "view").asof(points, "t", "v_")


# Windows.

DAILY = f"WITH {IV}, {_windows('iv', DAY, DAY)}"
HOPS = f"WITH {IV}, {_windows('iv', 3 * DAY, DAY)}"


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, count(*) AS n FROM wd GROUP BY ALL")
def tumbling_count(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).agg(n=F.count("*")).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, CAST(sum(cents) AS BIGINT) AS s FROM wd GROUP BY ALL")
def tumbling_sum(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).agg(s=F.sum("cents")).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, avg(cents) AS a FROM wd GROUP BY ALL")
def tumbling_avg(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).agg(a=F.avg("cents")).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, round(stddev_pop(cents), 4) AS sd FROM wd GROUP BY ALL")
def tumbling_stddev(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).agg(sd=F.round(F.stddev_pop("cents"), 4)).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, min(cents) AS lo, max(cents) AS hi, max(cents) - min(cents) AS span, arg_min(cents, c_st) AS first, arg_max(cents, c_st) AS last FROM wd GROUP BY ALL")
def tumbling_extremes(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).agg(lo=F.min("cents"), hi=F.max("cents"), span=F.max("cents") - F.min("cents"), first=F.min_by("cents", "c_st"), last=F.max_by("cents", "c_st")).df


@query(f"WITH {IV} SELECT user_id, ((et + {DAY - 1}) // {DAY} - 1) * {DAY} AS st, ((et + {DAY - 1}) // {DAY}) * {DAY} AS et, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM iv GROUP BY ALL")
def tumbling_points(spark, sf_dir):
    return users(spark, sf_dir).window(DAY, by="end").agg(n=F.count("*"), s=F.sum("cents")).df


@query(f"{HOPS} SELECT user_id, w_st AS st, w_et AS et, avg(cents) AS a, count(*) AS n FROM wd GROUP BY ALL")
def hopping_avg(spark, sf_dir):
    return users(spark, sf_dir).window(3 * DAY, DAY).agg(a=F.avg("cents"), n=F.count("*")).df


@query(f"WITH {EV}, {_kind('a', 'purchase', 6)}, {_windows('a', DAY, DAY)}, g AS (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s, w_et FROM wd GROUP BY user_id, w_et), k AS (SELECT DISTINCT user_id FROM g), gr AS (SELECT user_id, unnest(range({START + DAY}, {START + 30 * DAY} + 1, {DAY})) AS et FROM k) SELECT gr.user_id, gr.et - {DAY} AS st, gr.et, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM gr LEFT JOIN g ON g.user_id = gr.user_id AND g.w_et = gr.et")
def windows_with_empty(spark, sf_dir):
    return kind(spark, sf_dir, "purchase", 6).window(DAY).agg_all(START, START + 30 * DAY, {"n": 0, "s": 0}, n=F.count("*"), s=F.sum("cents")).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, round(sum(cents * (c_et - c_st))::DOUBLE / sum(c_et - c_st)::DOUBLE, 6) AS a FROM wd GROUP BY ALL")
def time_weighted_avg(spark, sf_dir):
    return users(spark, sf_dir).window(DAY).time_weighted("cents", "a").select(a=lambda e: F.round(e.a, 6)).df


@query(f"{DAILY} SELECT user_id, w_st AS st, w_et AS et, product(cents % 2 + 1) AS p, first(event_id ORDER BY cents DESC, c_et) AS largest, first(c_et ORDER BY cents, c_et) AS least_at FROM wd GROUP BY ALL")
def tumbling_product(spark, sf_dir):
    """Product, and the event and time of the extremes, the first among equals."""
    most = F.max_by("event_id", F.struct("cents", -F.col("c_et")))
    return users(spark, sf_dir).window(DAY).agg(p=F.product(F.col("cents") % 2 + 1), largest=most, least_at=F.min_by("c_et", F.struct("cents", "c_et"))).df


def _sliced(source: str, a: int, b: int, hop: int) -> str:
    return f"sl AS (SELECT *, unnest(range(((st - {b}) // {hop} + 1) * {hop}, ((et - {a} - 1) // {hop}) * {hop} + 1, {hop})) AS k FROM {source})"


@query(f"WITH {IV}, {_sliced('iv', 6 * HOUR, 30 * HOUR, DAY)} SELECT user_id, k - {DAY} AS st, k AS et, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM sl GROUP BY ALL")
def slice_future(spark, sf_dir):
    """At each midnight the events that hold from 6 to 30 hours later."""
    return users(spark, sf_dir).slice(6 * HOUR, 30 * HOUR, DAY).agg(n=F.count("*"), s=F.sum("cents")).df


@query(f"WITH {IV}, {_sliced('iv', -3 * DAY, -DAY, DAY)} SELECT user_id, k - {2 * DAY} AS st, k AS et, count(*) AS n, max(cents) AS hi FROM sl GROUP BY ALL")
def slice_past(spark, sf_dir):
    """At each midnight what held from three days to one day before."""
    return users(spark, sf_dir).slice(-3 * DAY, -DAY, DAY).agg(n=F.count("*"), hi=F.max("cents")).df


@query(f"{DAILY} SELECT user_id, c_st AS st, c_et AS et, round(cents - avg(cents) OVER (PARTITION BY user_id, w_et), 4) AS d FROM wd")
def join_with_aggregate(spark, sf_dir):
    """A scalar of one operator as an input of another: events less their day's mean."""
    events_ = users(spark, sf_dir).select(cents="cents")
    return events_.join(events_.window(DAY).agg(a=F.avg("cents")), d=lambda e, m: F.round(e.cents - m.a, 4)).df


@query(f"{DAILY}, li AS (SELECT user_id, w_st AS st, w_et AS et, list(cents ORDER BY c_st) AS l FROM wd GROUP BY ALL) SELECT user_id, st, et, CAST(list_reduce(list_prepend(1::BIGINT, l), lambda s, x: (s * 31 + x) % 1000003) AS BIGINT) AS h FROM li")
def reduce_fold(spark, sf_dir):
    """A fold in the order of time that no built-in aggregate is."""
    return users(spark, sf_dir).select(cents="cents").window(DAY).reduce("h", F.lit(1).cast("long"), lambda s, x: (s * 31 + x["cents"]) % 1000003).df


@query(f"WITH {IV}, x AS (SELECT user_id, st AS a, et + {3 * DAY - 1} AS b, cents FROM iv), p AS (SELECT user_id, a AS t FROM x UNION SELECT user_id, b FROM x), sg AS (SELECT user_id, t AS st, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS et FROM p) SELECT sg.user_id, sg.st, sg.et, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum FROM sg JOIN x ON x.user_id = sg.user_id AND x.a <= sg.st AND x.b >= sg.et WHERE sg.et IS NOT NULL GROUP BY ALL")
def sliding_sum(spark, sf_dir):
    return users(spark, sf_dir).sliding(3 * DAY, "cents").df


@query(f"WITH {IV} SELECT user_id, st, et, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY et RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS s, max(cents) OVER (PARTITION BY user_id ORDER BY et RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW) AS hi FROM iv")
def moving_range(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").moving(3 * DAY, s=F.sum("cents"), hi=F.max("cents")).df.drop("cents")


@query(f"WITH {IV} SELECT user_id, st, et, min(cents) OVER w AS lo, max(cents) OVER w AS hi FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY et RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW)")
def moving_extremes(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").moving_extremes(3 * DAY, "cents").df.drop("cents")


@query(f"WITH {_uniform(1)} SELECT user_id, st, et, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY et ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM un")
def moving_sum_10(spark, sf_dir):
    return uniform(spark, sf_dir, 1).moving_sum(10, "cents").select(s="sum").df


@query(f"WITH {_uniform(1)}, b AS (SELECT *, (et + 9) // 10 AS w FROM un) SELECT user_id, st, et, round((cents - avg(cents) OVER x) / nullif(stddev_pop(cents) OVER x, 0), 4) AS z FROM b WINDOW x AS (PARTITION BY user_id, w)")
def normalize_window(spark, sf_dir):
    return uniform(spark, sf_dir, 1).window(10, by="end").normalize("cents", "z").select(z=lambda e: F.round(e.z, 4)).df


@query(f"WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, (epoch_us(o_orderdate) + {30 * DAY - 1}) // {30 * DAY} AS w FROM orders) SELECT o_orderkey, round((c - avg(c) OVER (PARTITION BY w)) / nullif(stddev_pop(c) OVER (PARTITION BY w), 0), 4) AS z FROM o")
def orders_norm(spark, sf_dir):
    """Order values against those of their 30 days: a second event table."""
    rows = read_events(spark, f"{sf_dir}/orders.parquet", "o_orderdate", ["o_orderkey", "o_totalprice"])
    rows = rows.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), (F.col("t") - DAY).alias("st"), F.col("t").alias("et"))
    return TStream(rows).window(30 * DAY, by="end").normalize("c", "z").df.select("o_orderkey", F.round("z", 4).alias("z"))


# Clocks and recurrences.


@query(f"WITH {IV} SELECT user_id, k - {DAY} AS st, k AS et, k AS tick FROM (SELECT user_id, unnest(range((st // {DAY} + 1) * {DAY}, et + 1, {DAY})) AS k FROM iv)")
def beat_daily(spark, sf_dir):
    return users(spark, sf_dir).beat(DAY).df


@query(f"WITH {IV} SELECT user_id, k - {DAY} AS st, k AS et, k AS tick FROM (SELECT user_id, unnest(range(((st - {5 * HOUR}) // {DAY} + 1) * {DAY} + {5 * HOUR}, et + 1, {DAY})) AS k FROM iv)")
def beat_offset(spark, sf_dir):
    return users(spark, sf_dir).beat(DAY, 5 * HOUR).df


@query(f"WITH {IV}, p AS (SELECT user_id, st, et, cents AS ev, lag(cents) OVER (PARTITION BY user_id ORDER BY et) AS sv, lag(et) OVER (PARTITION BY user_id ORDER BY et) AS pe FROM iv) SELECT user_id, st, et, sv, ev FROM p WHERE pe = st")
def pair_samples(spark, sf_dir):
    return users(spark, sf_dir).pair("cents").df


def _resampled(source: str, table: str, period: int) -> str:
    return f"WITH {source}, p AS (SELECT user_id, st, et, cents AS ev, lag(cents) OVER (PARTITION BY user_id ORDER BY et) AS sv, lag(et) OVER (PARTITION BY user_id ORDER BY et) AS pe FROM {table}), g AS (SELECT *, unnest(range((st // {period} + 1) * {period}, et + 1, {period})) AS k FROM p WHERE pe = st) SELECT user_id, k - {period} AS st, k AS et, round((ev - sv) * (k - st) / (et - st)::DOUBLE + sv, 4) AS cents FROM g"


def _resample(ip: int, op: int) -> None:
    query(_resampled(_uniform(ip), "un", op), f"resample_{ip}_{op}")(lambda spark, sf_dir: uniform(spark, sf_dir, ip).resample(op, "cents").select(cents=lambda e: F.round(e.cents, 4)).df)


for _ip, _op in ((5, 4), (6, 3), (4, 5), (3, 6)):
    _resample(_ip, _op)


@query(_resampled(IV, "iv", 6 * HOUR))
def interpolate_events(spark, sf_dir):
    """Linear values every six hours between a user's events."""
    return users(spark, sf_dir).resample(6 * HOUR, "cents").select(cents=lambda e: F.round(e.cents, 4)).df


@query(f"WITH {EV}, {_kind('a', 'purchase', 6)} SELECT user_id, st, coalesce(lead(st) OVER (PARTITION BY user_id ORDER BY st), greatest(et, {START + 31 * DAY})) AS et, event_id, cents FROM a")
def fill_forward(spark, sf_dir):
    return kind(spark, sf_dir, "purchase", 6).fill(START + 31 * DAY).df


@query(f"WITH {IV} SELECT user_id, st, et, CAST(sum(cents) OVER w AS BIGINT) AS s, max(cents) OVER w AS hi, count(*) OVER w AS n FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY et ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    return users(spark, sf_dir).select(cents="cents").running(s=F.sum("cents"), hi=F.max("cents"), n=F.count("*")).df.drop("cents")


@query(f"WITH {_uniform(1)} SELECT x.user_id, x.st, x.et, round(sum(pow(0.5, x.et - y.et + 1) * y.cents), 3) AS ema FROM un x JOIN un y ON y.user_id = x.user_id AND y.et <= x.et GROUP BY ALL")
def recurrence_ema(spark, sf_dir):
    """``out = out / 2 + x / 2``: a fold within generated code."""
    out = uniform(spark, sf_dir, 1).recurrence(F.lit(0.0), lambda before, x: before * 0.5 + x["cents"] * 0.5, "ema")
    return out.select(ema=lambda e: F.round(e.ema, 3)).df


@query(ORACLE_SQL["recurrence_ema"])
def recurrence_by_key(spark, sf_dir):
    """The same by a Python function that sees a key's rows in batches."""

    def ema(frames):
        out = 0.0
        for frame in frames:
            values = []
            for v in frame["cents"]:
                out = out * 0.5 + v * 0.5
                values.append(out)
            yield frame[["user_id", "st", "et"]].assign(ema=values)

    out = uniform(spark, sf_dir, 1).by_key(ema, "user_id long, st long, et long, ema double")
    return out.withColumn("ema", F.round("ema", 3))


@query(f"WITH {IV}, {_windows('iv', 7 * DAY, 7 * DAY)}, r AS (SELECT user_id, c_st AS st, c_et AS et, cents, w_et, row_number() OVER (PARTITION BY user_id, w_et ORDER BY cents DESC, c_st) AS rk FROM wd) SELECT user_id, st, et, cents FROM r WHERE rk <= 3")
def nested_top_events(spark, sf_dir):
    """A stream-valued window: each week's three largest events, as intervals."""
    week = users(spark, sf_dir).select(cents="cents").window(7 * DAY).rows
    rank = F.row_number().over(Window.partitionBy("user_id", "w_et").orderBy(F.desc("cents"), "c_st"))
    return week.withColumn("rk", rank).filter("rk <= 3").select("user_id", F.col("c_st").alias("st"), F.col("c_et").alias("et"), "cents")


@query(f"{DAILY} SELECT user_id, w_et, c_st AS st, c_et AS et, CAST(sum(cents) OVER (PARTITION BY user_id, w_et ORDER BY c_st) AS BIGINT) AS s, lag(cents) OVER (PARTITION BY user_id, w_et ORDER BY c_st) AS before FROM wd")
def nested_running(spark, sf_dir):
    """Operators within each day's events: running sums, and the event before."""

    def own(day: TStream) -> TStream:
        sums = day.running(s=F.sum("cents"))
        return TStream(sums.df.withColumn("before", F.lag("cents").over(Window.partitionBy(*day.keys).orderBy("st"))).drop("cents"), day.keys)

    return users(spark, sf_dir).select(cents="cents").window(DAY).per_window(own).df


@query(f"{DAILY}, p AS (SELECT user_id, w_et, c_st AS st, c_et AS et, cents AS ev, lag(cents) OVER w AS sv, lag(c_et) OVER w AS pe FROM wd WINDOW w AS (PARTITION BY user_id, w_et ORDER BY c_et)), g AS (SELECT *, unnest(range((st // {HOUR} + 1) * {HOUR}, et + 1, {HOUR})) AS k FROM p WHERE pe = st) SELECT user_id, w_et, k - {HOUR} AS st, k AS et, round((ev - sv) * (k - st) / (et - st)::DOUBLE + sv, 4) AS cents FROM g")
def nested_resample(spark, sf_dir):
    """Linear resampling that never looks beyond the day."""
    return users(spark, sf_dir).select(cents="cents").window(DAY).per_window(lambda day: day.resample(HOUR, "cents")).select(cents=lambda e: F.round(e.cents, 4)).df


@query(ORACLE_SQL["moving_sum_10"])
def recurrence_moving_sum(spark, sf_dir):
    """``out = out[-1] + x - x[-10]``: a moving sum by self reference."""
    rows = uniform(spark, sf_dir, 1)
    gone = F.coalesce(F.lag("cents", 10).over(Window.partitionBy("user_id").orderBy("et")), F.lit(0))
    both = TStream(rows.df.withColumn("gone", gone), rows.keys)
    return both.recurrence(F.lit(0).cast("long"), lambda before, x: before + x["cents"] - x["gone"], "s").select(s="s").df


@query(f"WITH RECURSIVE {_uniform(1)}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS et, 1::BIGINT AS a, 1::BIGINT AS b, 1::BIGINT AS c FROM un UNION ALL SELECT un.user_id, un.et, (r.a + 2 * r.c + un.cents) % 1000003, r.a, r.b FROM r JOIN un ON un.user_id = r.user_id AND un.et = r.et + 1) SELECT user_id, et - 1 AS st, et, a AS o FROM r WHERE et > 0")
def recurrence_lookback(spark, sf_dir):
    """``out = out[-1] + 2 out[-3] + x``, in remainders."""
    out = uniform(spark, sf_dir, 1).recurrence(F.lit(1).cast("long"), lambda before, x: (before(1) + 2 * before(3) + x["cents"]) % 1000003, "o", back=3)
    return out.select(o="o").df


@query(f"WITH RECURSIVE {EV}, {_kind('a', 'click')}, ch AS (SELECT user_id, cents, k, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM (SELECT user_id, cents, unnest(range((st // {6 * HOUR} + 1) * {6 * HOUR}, et + 1, {6 * HOUR})) AS k FROM a)), r AS (SELECT user_id, n, k, (3 + cents) % 10007 AS o FROM ch WHERE n = 1 UNION ALL SELECT ch.user_id, ch.n, ch.k, (3 * r.o + ch.cents) % 10007 FROM r JOIN ch ON ch.user_id = r.user_id AND ch.n = r.n + 1) SELECT user_id, k - {6 * HOUR} AS st, k AS et, CAST(o AS BIGINT) AS o FROM r")
def recurrence_ticks(spark, sf_dir):
    """A step for each grid time at which a stream with gaps holds a value, not for each event."""
    out = kind(spark, sf_dir, "click").select(cents="cents").recurrence(F.lit(1).cast("long"), lambda before, x: (3 * before + x["cents"]) % 10007, "o", period=6 * HOUR)
    return out.select(o="o").df


# Structured Streaming: the same files as a stream, run to the end.


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(df: DataFrame) -> DataFrame:
    """Runs a stream over what there is into files that all executors see, and reads them."""
    from tidemark.streaming.run import drained

    return drained(df)


@query(f"WITH m AS (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 1 HOUR AS w FROM events), e AS (SELECT user_id, ((epoch_us(ts) + {DAY - 1}) // {DAY}) * {DAY} AS et, CAST(round(value * 100) AS BIGINT) AS cents FROM events) SELECT user_id, et - {DAY} AS st, et, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM e, m WHERE et <= epoch_us(m.w) GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    from tidemark.streaming import hopping

    live = _live(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = _drained(hopping(live, "ts", ["user_id"], "1 day", "1 day", "1 hour", n=F.count("*"), s=F.sum("cents")))
    return out.select("user_id", F.unix_micros("st").alias("st"), F.unix_micros("et").alias("et"), "n", "s")


@query(f"WITH {IV} SELECT user_id, st, et, cents FROM iv")
def stream_intervals(spark, sf_dir):
    from tidemark.streaming import live_intervals

    live = _live(spark, sf_dir).select(fn.tick("ts").alias("t"), "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return _drained(live_intervals(live, "t", "user_id", "cents", START))


@query(f"WITH {EV} SELECT a.user_id, a.event_id, b.event_id AS r_event_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t <= a.t AND b.t >= a.t - {6 * HOUR} WHERE a.event_type = 'purchase' AND b.event_type = 'click'")
def stream_interval_join(spark, sf_dir):
    from tidemark.streaming import interval_join

    def of(event_type):
        return _live(spark, sf_dir).filter(F.col("event_type") == event_type).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))

    return _drained(interval_join(of("purchase"), of("click"), ["user_id"], "ts", "6 HOURS", "1 hour")).select("user_id", "event_id", "r_event_id")
