"""The reference families with fixed seeds, and properties against brute force; row counts are exact."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import TStream
from tidemark import functions as fn
from tidemark.sources import checked_intervals, fixed_intervals, to_intervals


def stream(spark, rows, columns="k long, st long, et long, v long", keys=("k",)):
    return TStream(spark.createDataFrame(rows, columns), tuple(keys))


def got(s):
    df = s.df if isinstance(s, TStream) else s
    return sorted(tuple(r) for r in df.collect())


def random_rows(rng, keys=3, gaps=True, top=40):
    rows = []
    for k in range(keys):
        t = rng.randint(0, 5)
        while t < top:
            d = rng.randint(1, 7)
            if not gaps or rng.random() < 0.7:
                rows.append((k, t, t + d, rng.randint(-50, 50)))
            t += d
    return rows


def at(rows, k, t):
    """The value that holds at time t."""
    return next((r[3] for r in rows if r[0] == k and r[1] < t <= r[2]), None)


def uniform(n, step, seed=1, most=100_000):
    rng = random.Random(seed)
    return [(0, i * step, (i + 1) * step, rng.randint(0, most)) for i in range(n)]


@pytest.mark.parametrize("offset", [0, -2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_align_is_the_brute_force_lookup(spark, seed, offset):
    rng = random.Random(seed)
    a, b = random_rows(rng), random_rows(rng)
    out = stream(spark, a).align(lambda x, y: x.present | y.present, {"a": lambda x, y: F.when(x.present, x.v), "b": lambda x, y: F.when(y.present, y.v)}, stream(spark, b), offsets=(0, offset))
    segments = got(out)
    for k in range(3):
        for t in range(-5, 70):
            want = (at(a, k, t), at(b, k, t + offset))
            found = [s[3:] for s in segments if s[0] == k and s[1] < t <= s[2]]
            assert found == ([want] if want != (None, None) else [])


@pytest.mark.parametrize("period,origin", [(1, 0), (3, 0), (5, 3)])
def test_sampled_align_reads_grid_times(spark, period, origin):
    rng = random.Random(5)
    a, b = random_rows(rng), random_rows(rng)
    out = got(stream(spark, a).align(lambda x, y: x.present & y.present, {"d": lambda x, y: x.v - y.v}, stream(spark, b), period=period, origin=origin))
    for k in range(3):
        for t in range(origin, 60, period):
            x, y = at(a, k, t), at(b, k, t)
            assert [s[3] for s in out if s[0] == k and s[1] < t <= s[2]] == ([x - y] if x is not None and y is not None else [])


def test_slabs_and_keys_do_not_change_the_function(spark):
    rng = random.Random(8)
    a, b = random_rows(rng, 1), random_rows(rng, 1)
    whole = got(stream(spark, a).join(stream(spark, b), d=lambda l, r: l.v - r.v))
    cut = got(stream(spark, a).join(stream(spark, b), slab=4, d=lambda l, r: l.v - r.v))
    spread = lambda rows: sorted((k, t, v) for k, st, et, v in rows for t in range(st + 1, et + 1))
    assert spread(whole) == spread(cut) and len(cut) >= len(whole)
    free = [r[1:] for r in a]
    bare = got(TStream(spark.createDataFrame(free, "st long, et long, v long")).join(TStream(spark.createDataFrame([r[1:] for r in b], "st long, et long, v long")), slab=4, d=lambda l, r: l.v - r.v))
    assert bare == [r[1:] for r in cut]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "semi", "anti"])
def test_joins(spark, how):
    rng = random.Random(13)
    a, b = random_rows(rng, 2), random_rows(rng, 2)
    out = got(stream(spark, a).join(stream(spark, b), how, x=lambda l, r: F.when(l.present, l.v), y=lambda l, r: F.when(r.present, r.v)))
    for k in range(2):
        for t in range(0, 60):
            x, y = at(a, k, t), at(b, k, t)
            keep = {"inner": x is not None and y is not None, "semi": x is not None and y is not None, "left": x is not None, "right": y is not None, "outer": not (x is None and y is None), "anti": x is not None and y is None}[how]
            assert [s[3:] for s in out if s[0] == k and s[1] < t <= s[2]] == ([(x, y)] if keep else [])


def test_join_of_streams_without_common_time_is_empty(spark):
    a, b = stream(spark, [(0, 0, 5, 1)]), stream(spark, [(0, 5, 9, 2), (1, 0, 5, 3)])
    assert got(a.join(b, d=lambda l, r: l.v + r.v)) == []


@pytest.mark.parametrize("size,hop", [(5, 5), (6, 2), (4, 7), (1, 1)])
def test_windows_hold_what_overlaps_them(spark, size, hop):
    rng = random.Random(size * 10 + hop)
    rows = random_rows(rng)
    out = got(stream(spark, rows).window(size, hop).agg(n=F.count("*"), s=F.sum("v")))
    want = []
    for k in range(3):
        for t in range(-hop * 3, 80):
            if t % hop == 0:
                own = [r[3] for r in rows if r[0] == k and t > r[1] and t - size < r[2]]
                if own:
                    want.append((k, t - size, t, len(own), sum(own)))
    assert out == sorted(want)


def test_event_over_many_windows_and_empty_windows(spark):
    s = stream(spark, [(0, 2, 23, 7)])
    assert got(s.window(5).agg(n=F.count("*"))) == [(0, t, t + 5, 1) for t in range(0, 25, 5)]
    filled = got(s.window(5).agg_all(0, 40, {"n": 0}, n=F.count("*")))
    assert [r[3] for r in filled] == [1] * 5 + [0] * 3


def test_fold_and_time_weights(spark):
    s = stream(spark, [(0, 0, 4, 2), (0, 4, 10, 5), (0, 10, 13, 1)])
    assert got(s.window(10).reduce("p", F.lit(1).cast("long"), lambda a, x: a * 10 + x["v"])) == [(0, 0, 10, 125), (0, 10, 20, 11)]
    assert got(s.window(10).time_weighted("v", "a"))[0][3] == pytest.approx((2 * 4 + 5 * 6) / 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_sum_at_every_time(spark, seed):
    rows = random_rows(random.Random(seed))
    out = got(stream(spark, rows).sliding(6, "v"))
    for k in range(3):
        for t in range(0, 60):
            own = [r[3] for r in rows if r[0] == k and r[1] < t and r[2] > t - 6]
            assert [s[3:] for s in out if s[0] == k and s[1] < t <= s[2]] == ([(len(own), sum(own))] if own else [])


def test_select_family(spark):
    rows = uniform(1000, 5)
    s = stream(spark, rows)
    cases = {
        "add": (lambda e: e.v + 10, lambda v: v + 10),
        "sub": (lambda e: e.v - 10, lambda v: v - 10),
        "mul": (lambda e: e.v * 10, lambda v: v * 10),
        "div": (lambda e: fn.int_div(-e.v, 10), lambda v: -(v // 10)),
        "mod": (lambda e: fn.int_mod(-e.v, 10), lambda v: -(v % 10)),
        "max": (lambda e: fn.larger(e.v, 10), lambda v: max(v, 10)),
        "min": (lambda e: fn.smaller(e.v, 10), lambda v: min(v, 10)),
        "neg": (lambda e: -e.v, lambda v: -v),
        "abs": (lambda e: fn.absolute(10 - e.v), lambda v: abs(10 - v)),
        "sqrt": (lambda e: fn.root(e.v), math.sqrt),
        "pow": (lambda e: fn.power(e.v, 2.0), lambda v: float(v) ** 2),
        "ceil": (lambda e: fn.ceiling(e.v / 7), lambda v: float(math.ceil(v / 7))),
        "floor": (lambda e: fn.floored(e.v / 7), lambda v: float(math.floor(v / 7))),
    }
    out = got(s.select(**{n: f for n, (f, _) in cases.items()}))
    assert len(out) == 1000
    for row, (_, st, et, v) in zip(out, rows, strict=True):
        assert row[1:3] == (st, et) and list(row[3:]) == pytest.approx([f(v) for _, f in cases.values()])


def test_casts_and_divisions_by_zero(spark):
    df = spark.createDataFrame([(-2.7, 0), (2.5, 0), (3e10, 0), (float("nan"), 0)], "f double, z int")
    out = [tuple(r) for r in df.select(fn.to_type(F.col("f"), "int"), fn.safe_div("f" and F.col("f"), F.col("z")), fn.int_mod(F.lit(5), F.col("z")), fn.int_div(F.lit(5), F.col("z"))).collect()]
    assert [r[0] for r in out][:3] == [-2, 2, None]
    assert all(r[1:] == (None, None, None) for r in out)


def test_moving_sum(spark):
    rows = uniform(30, 1, 4)
    out = got(stream(spark, rows).moving(10, s=F.sum("v")))
    assert [r[4] for r in out] == [sum(r[3] for r in rows[max(0, i - 9) : i + 1]) for i in range(30)]


def test_normalize(spark):
    rows = uniform(1000, 1, 6)
    out = got(stream(spark, rows).window(10, by="end").normalize("v", "z"))
    assert len(out) == 1000
    for i in range(0, 1000, 10):
        own = [r[3] for r in rows[i : i + 10]]
        mean = sum(own) / 10
        sd = math.sqrt(sum((x - mean) ** 2 for x in own) / 10)
        assert [r[4] for r in out[i : i + 10]] == pytest.approx([(x - mean) / sd for x in own])


@pytest.mark.parametrize("ip,op", [(5, 4), (6, 3), (4, 5), (3, 6)])
def test_resample(spark, ip, op):
    rows = uniform(100, ip, ip)
    out = got(stream(spark, rows).resample(op, "v"))
    want = []
    for t in range(op, 100 * ip + 1, op):
        i = (t + ip - 1) // ip - 1  # the sample at or after t
        if i >= 1:
            want.append((0, t - op, t, (rows[i][3] - rows[i - 1][3]) * (t - rows[i][1]) / ip + rows[i - 1][3]))
    assert [r[:3] for r in out] == [w[:3] for w in want] and [r[3] for r in out] == pytest.approx([w[3] for w in want])


def test_pair_skips_gaps_and_fill_closes_them(spark):
    s = stream(spark, [(0, 0, 2, 1), (0, 2, 4, 3), (0, 6, 8, 5)])
    assert got(s.pair("v")) == [(0, 1, 2, 4, 3)] or got(s.pair("v").select(sv="sv", ev="ev")) == [(0, 2, 4, 1, 3)]
    assert got(s.fill(10)) == [(0, 0, 2, 1), (0, 2, 6, 3), (0, 6, 10, 5)]


def test_beat_chop_sample_shift_clip(spark):
    s = stream(spark, [(0, 3, 11, 1), (0, 11, 12, 2)])
    assert [r[3] for r in got(s.beat(4))] == [4, 8, 12]
    assert [r[3] for r in got(s.beat(4, 1))] == [5, 9]
    assert got(s.chop(4)) == [(0, 0, 4, 1), (0, 4, 8, 1), (0, 8, 12, 2)]
    assert got(s.sample(4)) == [(0, 0, 8, 1), (0, 8, 12, 2)]
    assert got(s.shift(2)) == [(0, 5, 13, 1), (0, 13, 14, 2)]
    assert got(s.clip(4, 11)) == [(0, 4, 11, 1)]


def test_recurrences(spark):
    s = stream(spark, [(0, 0, 1, 4), (0, 1, 2, 6), (1, 0, 1, 8)])
    folded = s.recurrence(F.lit(0.0), lambda before, x: before / 2 + x["v"], "o")
    assert [r[-1] for r in got(folded)] == [4.0, 8.0, 8.0]
    assert [r[-1] for r in got(s.running(n=F.sum("v")))] == [4, 10, 8]

    def total(frames):
        out = 0
        for frame in frames:
            yield frame[["k", "et"]].assign(o=frame["v"].cumsum() + out)
            out += frame["v"].sum()

    assert got(s.by_key(total, "k long, et long, o long")) == [(0, 1, 4), (0, 2, 10), (1, 1, 8)]


def test_asof_uses_what_is_live(spark):
    s = stream(spark, [(0, 0, 5, 1), (0, 5, 9, 2), (0, 12, 15, 3)])
    points = spark.createDataFrame([(0, t) for t in (0, 1, 5, 6, 9, 10, 12, 13)], "k long, t long")
    out = {r["t"]: r["x_v"] for r in s.asof(points, "t", "x_").collect()}
    assert out == {0: None, 1: 1, 5: 1, 6: 2, 9: 2, 10: None, 12: None, 13: 3}


def test_sources(spark):
    df = spark.createDataFrame([(0, 5, "a"), (0, 7, "b"), (0, 7, "c"), (1, 9, "d")], "k long, t long, v string")
    assert got(to_intervals(df, "t", ["k"], 0, ["v"]).select(v="v")) == [(0, 0, 5, "a"), (0, 5, 7, "b"), (1, 0, 9, "d")]
    assert got(fixed_intervals(df, "t", ["k"], 3, ["v"]).select(v="v")) == [(0, 2, 5, "a"), (0, 5, 7, "b"), (1, 6, 9, "d")]
    raw = spark.createDataFrame([(0, 0, 10, 1), (0, 2, 4, 2), (0, 8, 12, 3), (0, 5, 5, 4)], "k long, st long, et long, v long")
    assert got(checked_intervals(raw, ["k"]).select(v="v")) == [(0, 0, 10, 1), (0, 10, 12, 3)]
    with pytest.raises(Exception, match="overlap"):
        checked_intervals(raw, ["k"], overlap="fail").df.collect()


def test_empty_input(spark):
    s = stream(spark, [])
    assert got(s.join(s, d=lambda l, r: l.v)) == [] and got(s.window(5).agg(n=F.count("*"))) == [] and got(s.resample(3, "v")) == []


def test_tree_and_stateless_plans(spark):
    s = stream(spark, [(0, 0, 1, 1)])
    mapped = s.select(v="v").where(lambda e: e.v > 0).shift(3)
    assert "Exchange" not in mapped.df._jdf.queryExecution().executedPlan().toString()
    assert mapped.tree().splitlines()[0].startswith("shift(by=3) [row by row]")
    joined = mapped.join(s, d=lambda l, r: l.v)
    plan = joined.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_sink_macros_calls_and_partitioning(spark, tmp_path):
    from tidemark.sources import write_intervals

    s = stream(spark, [(0, 0, 2, 1), (1, 0, 4, 3)])
    write_intervals(s, f"{tmp_path}/out", partition_by=["k"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("k", "st", "et", "v").collect())) == got(s)

    @F.pandas_udf("long")
    def twice(v):
        return v * 2

    def doubled(x, by):
        return x.call("w", twice, "v").select(w=lambda e: e.w + by)

    assert got(s.apply(doubled, 1)) == [(0, 0, 2, 3), (1, 0, 4, 7)]
    dealt = s.partitioned()
    plan = dealt.running(n=F.sum("v")).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and got(dealt) == got(s)
    assert s.window(2).agg(n=F.count("*")).tree().splitlines()[1].strip().startswith("window(")


def test_lookups_into_the_future_are_refused(spark):
    s = stream(spark, [(0, 0, 2, 1)])
    with pytest.raises(ValueError, match="offset"):
        s.align(lambda a, b: a.present, {"v": lambda a, b: a.v}, s, offsets=(0, 1))


def test_hopping_windows_by_end_are_refused(spark):
    with pytest.raises(ValueError, match="tumble"):
        stream(spark, [(0, 0, 2, 1)]).window(4, 2, by="end")


def random_events(spark, n, seed, keys=3):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(keys)]), rng.randint(1, 400), i, rng.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, i long, v long")


@pytest.mark.parametrize("keys", [["k"], []])
def test_slabs_change_nothing(spark, keys):
    rows = random_events(spark, 120, 3)
    for slab in (1, 7, 50, 1000):
        for made in (lambda s: to_intervals(rows, "t", keys, 0, ["i"], s), lambda s: fixed_intervals(rows, "t", keys, 9, ["i"], s)):  # noqa: B023
            whole, cut = made(None), made(slab)
            order = lambda x: sorted(map(str, x.df.select(sorted(x.df.columns)).collect()))
            assert order(whole) == order(cut)
        whole = fixed_intervals(rows, "t", keys, 9, ["i"])
        assert order(whole.pair("v")) == order(whole.pair("v", slab)) and order(whole.fill(500)) == order(whole.fill(500, slab))
        assert order(whole.sliding(20, "v")) == order(whole.sliding(20, "v", slab)) and order(whole.moving_sum(20, "v")) == order(whole.moving_sum(20, "v", slab))
        points = rows.select("k", "t", "i")
        if keys:
            same = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
            assert same(whole.asof(points, "t", "x_")) == same(whole.asof(points, "t", "x_", slab))


def test_slabs_are_tasks(spark):
    rows = random_events(spark, 50, 4)
    plan = fixed_intervals(rows, "t", [], 9, ["i"], 20).df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "SinglePartition" in fixed_intervals(rows, "t", [], 9, ["i"]).df._jdf.queryExecution().executedPlan().toString()


def test_time_bounds_reach_the_scan(spark, tmp_path):
    from tidemark.sources import read_events

    for kind in ("timestamp", "timestamp_ntz"):
        spark.range(0, 1000).selectExpr(f"cast(timestamp_micros(id) AS {kind}) AS ts", "id").write.parquet(f"{tmp_path}/{kind}")
        rows = read_events(spark, f"{tmp_path}/{kind}", "ts", ["id"], t0=10, t1=20)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(ts" in plan and "LessThanOrEqual(ts" in plan
        assert sorted(r["id"] for r in rows.collect()) == list(range(11, 21))


def test_keys_may_be_null(spark):
    rows = [(None, i, i + 1, 1) for i in range(25)] + [(2, i, i + 1, 1) for i in range(5)]
    s = TStream(spark.createDataFrame(rows, "k long, st long, et long, v long"), ("k",))

    def count(frames):
        n = 0
        for frame in frames:
            n += len(frame)
        yield frame[["k"]].head(1).assign(n=n)

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 4)
    try:
        assert sorted((r["k"] or 0, r["n"]) for r in s.by_key(count, "k long, n long").collect()) == [(0, 25), (2, 5)]
    finally:
        spark.conf.unset(size)
    assert s.window(100, by="end").normalize("v", "z").df.count() == 30


def test_recurrences_look_back_and_take_time_in_proportion(spark):
    import time

    values = [random.Random(5).randint(0, 9) for _ in range(600)]
    s = stream(spark, [(0, i, i + 1, v) for i, v in enumerate(values)])
    outs = [1, 1, 1]
    for v in values:
        outs.append((outs[-1] + 2 * outs[-3] + v) % 1009)
    found = s.recurrence(F.lit(1).cast("long"), lambda before, x: (before(1) + 2 * before(3) + x["v"]) % 1009, "o", back=3)
    assert [r[-1] for r in got(found)] == outs[3:]
    times = []
    for n in (20_000, 80_000):
        long = TStream(spark.range(n).selectExpr("0L AS k", "id AS st", "id + 1 AS et", "id % 7 AS v"), ("k",))
        began = time.perf_counter()
        assert long.recurrence(F.lit(0).cast("long"), lambda before, x: before + x["v"], "o").df.agg(F.max("o")).first()[0] == sum(i % 7 for i in range(n))
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0] + 1


def test_moving_sums_and_slices(spark):
    rng = random.Random(6)
    rows, t = [], 0
    for _ in range(200):
        t += rng.randint(0, 3)
        rows.append((0, t, t + 1, rng.randint(-5, 5)))
        t += 1
    s = stream(spark, rows)
    out = got(s.moving_sum(12, "v"))
    assert [r[-2:] for r in out] == [(len(x := [v for _, _, e, v in rows if et - 12 < e <= et]), sum(x)) for _, _, et, _ in rows]
    for size in (1, 3, 12, 1000):
        out = got(s.moving_extremes(size, "v"))
        own = [[v for _, _, e, v in rows if et - size < e <= et] for _, _, et, _ in rows]
        assert [r[-2:] for r in out] == [(min(x), max(x)) for x in own]
    for a, b, hop in ((-7, -2, 3), (2, 9, 4), (-3, 5, 5)):
        found = {r[2]: r[3] for r in got(s.slice(a, b, hop).agg(n=F.count("*")))}
        times = range(-12, t + 12)
        assert found == {T: n for T in times if T % hop == 0 and (n := sum(st < T + b and et > T + a for _, st, et, _ in rows))}
    with pytest.raises(ValueError, match="slice"):
        s.slice(2, 2, 1)


def test_live_intervals_idle_late_and_states(spark, tmp_path):
    from tidemark.streaming import live_intervals
    from tidemark.streaming.run import drained

    # Three files, one batch each; the second has events that are late, the third comes after a long pause.
    for i, rows in enumerate([[(1, 5, 50), (2, 9, 90)], [(1, 3, 30), (1, 8, 80), (2, 9, 91)], [(1, 500, 51), (2, 501, 92)]]):
        spark.createDataFrame(rows, "k long, t long, v long").selectExpr("k", "t", "v", "timestamp_seconds(t) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:
            schema = spark.read.parquet(f"{tmp_path}/in").schema

    def run(**more):
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return sorted(map(tuple, drained(live_intervals(live, "t", "k", "v", 0, **more)).collect()), key=str)

    assert run() == sorted([(1, 0, 5, 50), (2, 0, 9, 90), (1, 5, 8, 80), (1, 8, 500, 51), (2, 9, 501, 92)], key=str)
    assert run(idle=4) == sorted([(1, 1, 5, 50), (2, 5, 9, 90), (1, 5, 8, 80), (1, 496, 500, 51), (2, 497, 501, 92)], key=str)
    assert run(idle=4, watermark=("ts", "1 second")) == run(idle=4)
    late = [r for r in run(keep_late=True) if r[1] is None]
    assert late == [(1, None, 3, 30), (2, None, 9, 91)]
    with pytest.raises(ValueError, match="idle"):
        live_intervals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "t", "k", "v", 0, watermark=("ts", "1 second"))


def test_a_local_application_gets_a_folder(spark):
    from types import SimpleNamespace

    from tidemark.streaming.run import shared_folder

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get("dir", d)), sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}", getConf=dict))

    assert shared_folder(session("local[2]", dir="s3://x/y")) == "s3://x/y"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]")).removesuffix("/")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session("spark://host:7077"))


def test_slabs_are_derived_from_the_largest_key(spark):
    rows = [(1, i, i + 1, 1) for i in range(1000)] + [(2, 0, 5000, 1)]
    s = stream(spark, rows)
    assert s.slab_for(100) == 100 and s.slab_for(1000) is None and stream(spark, []).slab_for() is None
    other = stream(spark, [(1, 3 * i, 3 * i + 2, 2) for i in range(300)])
    joined = lambda slab: sum(r["et"] - r["st"] for r in s.join(other, slab=slab, v=lambda a, b: b.v).df.collect())
    assert joined(s.slab_for(100)) == joined(None) == 600
