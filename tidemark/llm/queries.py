"""The queries ``opN_<name>`` of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, embed_dedup, html_extract, license_scan, ngram_join, quality, substring_dedup, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), keep_ids=False, keep_decoded=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), k=35, keep_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_embed_dedup": op5_embed_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
}

#: Words of ``words.shingles`` in the lower-cased text of a table, as a list.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+')"


def _window(words: str, k: str) -> str:
    """The run of ``k`` words, or of all words of a shorter list, from place ``i`` on."""
    return f"array_to_string({words}[i : i + least({k}, len({words})) - 1], ' ')"


def _places(words: str, k: str) -> str:
    return f"unnest(range(1, greatest(len({words}) - {k} + 2, CASE WHEN len({words}) > 0 THEN 2 ELSE 1 END)))"


#: Least id that links reach, of ``link`` (a, b) in both directions and ``node`` (id).
_COMPONENTS = "reach AS (SELECT id, id AS head FROM node UNION SELECT link.a, reach.head FROM reach JOIN link ON link.b = reach.id), comp AS (SELECT id, min(head) AS component FROM reach GROUP BY id)"

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS l FROM documents),
        items AS (SELECT row_number() OVER () AS q, item_id, l, least(len(l), 5) AS k FROM (SELECT item_id, {_WORDS} AS l FROM benchmark) WHERE len(l) > 0),
        ds AS (SELECT DISTINCT r, k, {_window('l', 'k')} AS s FROM (SELECT r, l, k, {_places('l', 'k')} AS i FROM docs, (SELECT DISTINCT k FROM items))),
        qs AS (SELECT DISTINCT q, k, {_window('l', '5')} AS s FROM (SELECT q, l, k, {_places('l', '5')} AS i FROM items)),
        sizes AS (SELECT q, count(*) AS n FROM qs GROUP BY q),
        found AS (SELECT r, q, count(*) AS f FROM ds JOIN qs USING (k, s) GROUP BY r, q)
        SELECT doc_id, item_id, f AS n_found, n AS n_shingles, f / n AS containment
        FROM found JOIN sizes USING (q) JOIN docs USING (r) JOIN items USING (q) WHERE 5 * f >= 4 * n
    """,
    "op5_embed_dedup": f"""
        WITH RECURSIVE fine AS (
            SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
        ), link AS (
            SELECT a.id AS a, b.id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), node AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
        SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM comp
    """,
    "op7_ngram_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id AS id, {_WORDS} AS l FROM documents),
        sh AS (SELECT DISTINCT id, {_window('l', '5')} AS s FROM (SELECT id, l, {_places('l', '5')} AS i FROM docs)),
        sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
        link AS (SELECT a, b, c = sa.n AND c = sb.n AS same FROM shared JOIN sizes sa ON sa.id = a JOIN sizes sb ON sb.id = b WHERE 9 * c >= 4 * (sa.n + sb.n)),
        node AS (SELECT id FROM docs), {_COMPONENTS}
        SELECT comp.id AS doc_id, component AS class_id, least(comp.id, coalesce((SELECT min(b) FROM link WHERE a = comp.id AND same), comp.id)) AS copy_of, (SELECT count(*) FROM link WHERE a = comp.id) AS n_links FROM comp
    """,
    "op8_substring_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        wins AS (SELECT r, i, array_to_string(l[i : i + 34], ' ') AS s FROM (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM docs)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM wins) WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM again),
        words AS (SELECT r, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS j FROM docs),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, len(l) AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
    """,
    "op9_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), named AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), judged AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
    """,
}
