"""Operators over a whole corpus, against brute force on small fixtures with copies, hot passages and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import embed_dedup, ngram_join, substring_dedup
from tidemark.llm.components import components, forest
from tidemark.llm.scratch import Scratch
from tidemark.llm.words import shingles

DOCS = "doc_id long, text string, key string, node long, spans string"


def corpus(seed, n=120, k=35):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passages = [[word() for _ in range(rng.randint(k - 2, 3 * k))] for _ in range(6)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 120))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            at = rng.randint(0, len(words))
            words[at:at] = p[a:b] if rng.random() < 0.3 else p
        if texts and i % 5 == 0:
            words = (texts[rng.randrange(len(texts))] or "").split()
            if words and i % 2:
                words[rng.randrange(len(words))] = word()
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return [*texts, None, "", " \n", "same " * 90, "tick tock " * 60, "one"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, None) for i, t in enumerate(texts)], DOCS)


def windows_cut(texts, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        yield len(w), sum(gone), kept


@pytest.mark.parametrize("seed,k,shard", [(1, 35, None), (2, 12, None), (3, 12, 3), (4, 5, 2), (6, 35, 2)])
def test_substring_dedup_is_exact(spark, monkeypatch, seed, k, shard):
    if shard:  # anchors with more stretches go the other way
        monkeypatch.setattr(substring_dedup, "SHARD", shard)
    texts = corpus(seed, k=k)
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs(spark, texts), k=k).collect()}
    assert len(out) == len(texts)
    for i, (n, removed, kept) in enumerate(windows_cut(texts, k)):
        r = out[i]
        assert (r["n_words"], r["n_removed"]) == (n, removed), i
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (r["kept"] or "").split() == kept and (removed or r["kept"] == (texts[i] or ""))


def test_substring_dedup_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f g"), (2, "z a b c")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(rows, k=3).collect())
    assert out == [(0, 7, 6), (1, 6, 6), (1, 6, 6), (2, 4, 3)]
    assert substring_dedup.substring_dedup(rows.limit(0)).count() == 0
    named = substring_dedup.substring_dedup(rows.withColumnRenamed("doc_id", "key"), id_col="key", k=3, keep_text=False)
    assert named.columns == ["key", "n_words", "n_removed", "kept_sha256"] and sorted((r["key"] or 0, r["n_removed"]) for r in named.collect()) == [(0, 6), (1, 6), (1, 6), (2, 3)]
    long = spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(120_000)) + " " + "x" * 2_000_000)], "doc_id long, text string")
    assert [(r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(long, keep_text=False).collect()] == [(120_001, 120_000)]
    cut = substring_dedup.replace_texts(docs(spark, ["a b c d", "x a b c y"]).withColumnRenamed("node", "n_chars"), length_col="n_chars", k=3)
    assert cut.columns == ["doc_id", "text", "key", "n_chars", "spans"] and sorted((r["text"], r["n_chars"]) for r in cut.collect()) == [("d", 1), ("x y", 3)]


def test_suffix_automaton_counts():
    rng = random.Random(7)
    for _ in range(50):
        rows = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        weights = [rng.choice([1, 1, 2]) for _ in rows]
        automaton = substring_dedup.SuffixAutomaton()
        for r, w in zip(rows, weights, strict=True):
            automaton.add(r, w)
        automaton.finish()
        for k in (1, 3, 5):
            count = Counter()
            for r, w in zip(rows, weights, strict=True):
                for i in range(len(r) - k + 1):
                    count[tuple(r[i : i + k])] += w
            for r in rows:
                assert automaton.repeated(r, k) == [i for i in range(len(r) - k + 1) if count[tuple(r[i : i + k])] > 1]


def jaccard_links(texts):
    sets = [set(shingles(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 - 1e-12]
    return links


def groups(n, links):
    head = list(range(n))

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(seed, n=150, group=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts, bases = [], [[word() for _ in range(rng.randint(1, 150))] for _ in range(20)]
    hot = [word() for _ in range(100)]
    for i in range(n):
        words = list(hot if i < group else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return [*texts, None, "", "?!", "x", "X!", "the very same line of text", "the very same line of text"]


@pytest.mark.parametrize("seed,small,block", [(1, 64, 512), (2, 4, 8)])
def test_ngram_join_loses_no_link(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BUCKET", block)
    texts = near_copies(seed)
    links = jaccard_links(texts)
    count = Counter(x for pair in links for x in pair)
    out = {r["doc_id"]: r for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert len(out) == len(texts) and len(links) > 500
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == {i: (g, count[i]) for i, g in enumerate(groups(len(texts), links))}
    assert out[len(texts) - 1]["copy_of"] == len(texts) - 2
    kept = ngram_join.keep_one(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(len(texts), links))) and kept.columns == docs(spark, []).columns


def test_ngram_join_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c, d e f"), (3, "other words"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join.ngram_join(rows).collect())
    assert out == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert sorted(r["doc_id"] or 0 for r in ngram_join.keep_one(rows).collect()) == [0, 0, 1, 3]
    assert ngram_join.ngram_join(rows.limit(0)).count() == 0


def test_ngram_join_ids_of_any_type(spark):
    rows = spark.createDataFrame([("b", "a b c d e f", "x"), ("a", "A b c d e, f", "x"), ("c", "other words", "x"), (None, "a b c d e f", "x")], "doc_id string, text string, node string")
    out = sorted(tuple(x or "" for x in r) for r in ngram_join.ngram_join(rows).collect())
    assert out == [("", "", "", ""), ("a", "a", "a", 1), ("b", "a", "a", 1), ("c", "c", "c", "")]
    assert sorted(r["doc_id"] or "" for r in ngram_join.keep_one(rows).collect()) == ["", "a", "c"]
    small = ngram_join.ngram_join(rows.selectExpr("cast(ascii(doc_id) as smallint) AS doc_id", "text"))
    assert small.schema["class_id"].dataType.simpleString() == "smallint" and small.filter("n_links = 1").count() == 2


def test_keep_one_keeps_the_text_that_was_compared(spark):
    one, other = "a b c d e f g", "h i j k l m n"
    for texts in ([one, other], [other, one]):
        rows = spark.createDataFrame([(2, t) for t in texts] + [(1, one)], "doc_id long, text string")
        compared = min(texts, key=lambda t: hashlib.md5(t.encode()).digest())
        kept = sorted(tuple(r) for r in ngram_join.keep_one(rows).collect())
        assert kept == ([(1, one)] if compared == one else [(1, one), (2, other)])


def test_ngram_join_of_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    texts = [" ".join(words), " ".join(words[:190_000]), " ".join(words[:100_000]), "x" * 3_000_000]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert out == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}


def test_ngram_join_parts_chains(spark, monkeypatch):
    """Texts that are a little like the next one: a cluster of sketches, not one of links, and no pairs of it are compared."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    words = [f"w{i}" for i in range(10_000)]
    chain = [" ".join(words[17 * i : 17 * i + 104]) for i in range(200)]  # similar by 0.71, 0.49, ...
    members, clusters = [], []
    compared, parted = ngram_join._compared, ngram_join._parted
    monkeypatch.setattr(ngram_join, "_compared", lambda m, *rest: members.append(m.count()) or compared(m, *rest))
    monkeypatch.setattr(ngram_join, "_parted", lambda c, *rest: clusters.append(c.count()) or parted(c, *rest))
    texts = [*chain, chain[50] + " more", *near_copies(3, 30, 20)]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    links = jaccard_links(texts)
    count = Counter(x for pair in links for x in pair)
    assert out == {i: (g, count[i]) for i, g in enumerate(groups(len(texts), links))}
    assert clusters[0] > 200 and members[-1] < 60 and members[0] < 30 * len(chain)


def test_paths_split_buckets_until_they_are_small(spark, monkeypatch):
    """Texts with a common passage and little else in common: large buckets that further steps split."""
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(12)] for _ in range(12)]
    texts = []
    for i in range(160):
        own = [w for p in rng.sample(passages, 6) for w in p] + [word() for _ in range(30)]
        texts.append(" ".join(own))
        if i % 4 == 0:
            texts.append(" ".join([*own, word()]))
    depths = []
    deeper = ngram_join._deeper
    monkeypatch.setattr(ngram_join, "_deeper", lambda *a: depths.append(1) or deeper(*a))
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    links = jaccard_links(texts)
    count = Counter(x for pair in links for x in pair)
    assert depths and len(links) >= 40
    assert out == {i: (g, count[i]) for i, g in enumerate(groups(len(texts), links))}


def test_recall_falls_slowly_with_depth():
    runs = ngram_join.runs_for(0.999)
    assert ngram_join.recall_at(2, runs) >= 0.999 and ngram_join.recall_at(ngram_join.DEPTH, runs) >= 0.94


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.999) > ngram_join.runs_for(0.9) > 1


def cosine_links(rows, least=0.93):
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    yield i, j


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def vectors(seed, n=260, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.25])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 2)) if i > 120 else 0))
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    return rows + [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + len(odd), [1.0] * dim, None), (n + len(odd) + 1, (np.array(rows[0][1]) * 3).tolist(), 0)]


@pytest.mark.parametrize("cell,block", [(4096, 2048), (20, 2048), (10, 7)])
def test_embedding_dedup_is_exact(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors(5)
    links = list(cosine_links(rows))
    count = Counter(x for pair in links for x in pair)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    out = {r["vec_id"]: r for r in embed_dedup.embedding_dedup(table, cell=cell).collect()}
    assert len(out) == len(rows) and len(links) > 1000
    for i, g in enumerate(groups(len(rows), links)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (count[i], g, i == g)


def test_ngram_join_counts_repeated_rows_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text), (2, f"{text} more")], "doc_id long, text string").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 1)
    try:
        out = ngram_join.ngram_join(rows.union(rows).union(rows)).collect()
    finally:
        spark.conf.unset(size)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == [(1, 1, 1)] * 3 + [(2, 1, 1)] * 3


def test_embedding_dedup_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.embedding_dedup(rows).collect())
    assert out == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    twice = embed_dedup.embedding_dedup(rows.filter("vec_id IS NULL").union(rows).union(rows.filter("vec_id IS NULL"))).collect()
    assert sum(r["vec_id"] is None and not r["kept"] and r["n_links"] == 0 for r in twice) == 3
    named = embed_dedup.embedding_dedup(rows.selectExpr("concat('v', vec_id) AS vec_id", "embedding", "label", "1 AS node", "2 AS kept")).collect()
    assert sorted((r["vec_id"] or "", r["n_links"], r["component_id"] or "", r["kept"]) for r in named) == [("", 0, "", False), ("v1", 1, "v1", True), ("v1", 1, "v1", True), ("v2", 1, "v1", False), ("v3", 0, "v3", True)]
    assert embed_dedup.embedding_dedup(rows.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [-1e300, 1e300], 1), (4, [5e-324, 0.0], 1), (5, [2.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.embedding_dedup(far).collect())
    assert out == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_cells_hold_every_vector_within_reach():
    """Any two within the radius meet in one cell, at home in one at least; clustered vectors are copied little."""
    rng = np.random.default_rng(4)
    radius = np.sqrt(2 - 2 * 0.93)
    centres = embed_dedup._unit(rng.normal(size=(60, 16)))
    near = embed_dedup._unit(centres[rng.integers(0, 60, 800)] + 0.05 * rng.normal(size=(800, 16)))
    wide = embed_dedup._unit(rng.normal(size=(800, 64)))
    for units, most in ((near, 10), (wide, 20)):
        pivots = units[:40]
        home, reach = embed_dedup.reached(embed_dedup._distances(units, pivots), embed_dedup._distances(pivots, pivots), radius)
        for i, j in zip(*np.nonzero(units @ units.T >= 0.93), strict=True):
            met = [c for c in range(40) if reach[i, c] and reach[j, c] and c in (home[i], home[j])]
            assert met == [min(home[i], home[j])]
        assert reach.sum() / len(units) <= most


def test_cells_take_little_memory():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(9)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 2000), pa.array(range(2000)), pa.array([1] * 2000), pa.array(rng.normal(size=(2000, 64)).tolist())], ["label", "node", "copies", "vector"])
    pivots = SimpleNamespace(value={"a/64": rng.normal(size=(2048, 64)).tolist()})
    tracemalloc.start()
    n = sum(b.num_rows for b in embed_dedup._cells(pivots, np.sqrt(2 - 2 * 0.93))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 2000 and peak < 300_000_000


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500 + i) for i in range(1, 60)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = groups(600, [e for e in edges if e[0] != e[1]])
    assert out == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_scratch_tables_are_cleared(spark, tmp_path, monkeypatch):
    from tidemark.llm import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(scratch, "_MADE", [])
    own = Scratch(spark)
    a, b = own.table(spark.range(5)), own.buckets(spark.range(7), "id")
    assert a.count() == 5 and b.count() == 7 and len(list(tmp_path.glob("tidemark/*/*"))) == 2
    assert "Exchange" not in b.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    own.drop(a)
    assert len(list(tmp_path.glob("tidemark/*/*"))) == 1
    scratch.clear(spark)
    assert not list(tmp_path.glob("tidemark/*")) and not scratch._MADE


def test_scratch_tables_keep_the_drivers_heap_small(spark, monkeypatch):
    """Each table that is written collects the driver's garbage if that has spread over half of the heap."""
    from types import SimpleNamespace

    from tidemark.llm import scratch

    asked = []
    monkeypatch.setattr(scratch, "tidy", asked.append)
    Scratch(spark).table(spark.range(3))
    assert asked == [spark]
    monkeypatch.undo()
    for total, runs in ((40, 0), (60, 1)):
        collected = []
        runtime = SimpleNamespace(totalMemory=lambda total=total: total, maxMemory=lambda: 100)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda runtime=runtime: runtime), System=SimpleNamespace(gc=lambda collected=collected: collected.append(1)))
        scratch.tidy(SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang))))
        assert len(collected) == runs


def test_forest_spans_what_is_linked():
    rng = np.random.default_rng(1)
    linked = rng.random((60, 60)) < 0.03
    linked |= linked.T
    edges = forest(lambda i, rest: linked[i, rest], 60)
    pairs = [(i, j) for i in range(60) for j in range(i) if linked[i, j]]
    assert groups(60, edges) == groups(60, pairs) and len(edges) == 60 - len(set(groups(60, pairs)))


def test_frequent_paths_are_large_without_meeting(spark, monkeypatch):
    rows = spark.createDataFrame([(7, i) for i in range(300)] + [(i, i) for i in range(100, 400)] + [(5, 1), (5, 2), (6, 3), (6, 4), (6, 5)], "path long, node long")
    for frequent in (4096, 1):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        small, large = ngram_join.met(rows, 3)
        assert sorted(sorted(r["members"]) for r in small.collect()) == [[1, 2], [3, 4, 5]]
        assert sorted(tuple(r) for r in large.collect()) == [(7, i) for i in range(300)]
    monkeypatch.setattr(ngram_join, "FREQUENT", 4096)
    texts = near_copies(4, 80, 60)
    monkeypatch.setattr(ngram_join, "SMALL", 5)
    links = jaccard_links(texts)
    count = Counter(x for pair in links for x in pair)
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert out == {i: (g, count[i]) for i, g in enumerate(groups(len(texts), links))}
