"""The pipeline's stages against brute force, on a small table of documents."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_corpus import groups, jaccard_links, windows_cut
from tests.llm.test_rowwise import brute_containment

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage_drops_what_is_marked_low(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = by_id(stages[1])
    told = Counter((labels[i] == 1) == (i in kept) for i in by_id(stages[0]) if i in labels)
    assert told[False] <= 0.05 * sum(told.values())


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    ids = sorted(before)
    heads = groups(len(ids), jaccard_links([before[i]["text"] for i in ids]))
    assert sorted(after) == [ids[h] for h in sorted(set(heads))]


def test_repeats_are_cut(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert sorted(before) == sorted(after)
    ids = sorted(before)
    for i, (_, _, kept) in zip(ids, windows_cut([before[i]["text"] for i in ids], 35), strict=True):
        assert after[i]["text"].split() == kept and after[i]["n_chars"] == len(after[i]["text"])


def test_contaminated_documents_go(spark, stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = sorted(before)
    hit = {ids[i] for i, *_ in brute_containment([before[i]["text"] for i in ids], items)}
    assert sorted(after) == sorted(set(ids) - hit)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256").collect())) == sorted(map(tuple, stages[5].select("doc_id", "n_tokens", "ids_sha256").collect()))


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, no rows, and a column with a clashing name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.limit(60)
    odd = some.unionByName(some.limit(5)).unionByName(some.limit(4).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")).unionByName(spark.createDataFrame([(10_000_001, None, None, None, None), (10_000_002, "", "en", "x", 0), (None, None, None, None, 3)], docs.schema))
    odd = odd.selectExpr("*", "'clash' AS key", "1 AS head", "2 AS node", "3 AS `_key`", "4 AS cut", "5 AS hit")
    for rows in (odd, odd.limit(0)):
        now = rows
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, DATA)
            path = f"{tmp_path}/{i}-{rows is odd}"
            out.write.parquet(path)
            before, now = now, spark.read.parquet(path)
            assert now.count() <= before.count()
            if i < 4:
                assert now.columns == odd.columns
    ids = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1-True").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
