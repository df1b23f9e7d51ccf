"""URL filters (operator 9), native: DataFrame functions only.

Listed canonical URL prefixes (host, path) go into a blocked Bloom filter: one
64-bit word is a block, and a key sets ``BITS`` bits of one block.  Each page
has one candidate key for every suffix of its host and every listed path
length; the filter passes possible hits, and an exact hash join with the list
removes its false positives.  The longest listed prefix decides.  Paths longer
than ``max_path`` have their first ``max_path`` characters in the key, and the
join compares the rest, so the number of candidates has a bound.

The filter has a word for every four listed keys (16 bits a key, so few pages
pass in vain), but at most ``MOST_BLOCKS`` (1 MB) however long the list is; past
that more pages take the join, with the same results.  So it goes to the
executors as a constant of the plan.  Pages without a possible hit are never
shuffled.  Of a host only suffixes with at most as many labels as a listed host
has are looked at.

Defined results: a null url or one without ``://`` has an empty host and path
and no rule; null ids are kept; an empty list gives every page the default verdict; repeated rows
stay repeated; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
#: Words of the filter at least and at most.
LEAST_BLOCKS, MOST_BLOCKS = 64, 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path without query and fragment; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _constant(numbers: list[int], kind: str) -> Column:
    """A constant array, written as one literal: the plan stays small."""
    text = F.split(F.lit(",".join(map(str, numbers))), ",") if numbers else F.array()
    return text.cast(f"array<{kind}>")


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row: the filter as an array of ``blocks`` words."""
    spark = keys.sparkSession
    used = keys.groupBy(_block(F.col(key), blocks).alias("b")).agg(F.bit_or(_mask(F.col(key))).alias("w"))
    dense = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("w")).unionByName(used)
    dense = dense.groupBy("b").agg(F.bit_or("w").alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("words"))


def fitting_blocks(n: int) -> int:
    """Words of a filter of ``n`` keys: 16 bits a key, within bounds."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(0, n // 4 - 1).bit_length()))


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter holds the key: surely so for those put in, and for few others."""
    return F.element_at(words, _block(key, blocks) + 1).bitwiseAND(_mask(key)) == _mask(key)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int | None = None, max_path: int = 2048) -> DataFrame:
    """One row for each page: id, ``host``, ``path``, ``rule`` (null without one) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and
    all subdomains where the page's path starts with the rule's; the longest
    wins, and ``block`` among equals.
    """
    listed = rules.groupBy(F.concat("host", F.substring("path", 1, max_path)).alias("key"), F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    # All are of bounded size: the filter has at most MOST_BLOCKS words, and there are at most ``max_path`` lengths.
    size = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    if blocks is None:
        blocks = fitting_blocks(size["n"])
    words = _constant(bloom_words(listed, "key", blocks).first()["words"], "long")
    lengths = _constant([r["n"] for r in listed.select(F.least(F.length("r_path"), F.lit(max_path)).alias("n")).distinct().collect()], "int")
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("p_id"), F.col(url_col).alias("p_url"), host.alias("p_host"), path.alias("p_path"))

    labels = F.split("p_host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - F.lit((size["labels"] or 1) - 1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length("p_path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(F.concat(s, F.substring("p_path", F.lit(1), n)).alias("key"), s.alias("host"), n.alias("n")))))
    passing = F.filter(keys, lambda k: may_hold(words, k["key"], blocks))
    judged = base.withColumn("hits", passing)

    missed = judged.filter(F.size("hits") == 0).select(F.col("p_id").alias(id_col), F.col("p_host").alias("host"), F.col("p_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    same = ["p_id", "p_url", "p_host", "p_path"]
    hit = judged.filter(F.size("hits") > 0).groupBy(*same).agg(F.count("*").cast("int").alias("copies"))
    # Cheaper found again than sorted and shuffled.
    hit = hit.select(*same, "copies", F.explode(passing).alias("hit"))
    exact = hit.join(listed, (F.col("hit.key") == F.col("key")) & (F.col("hit.host") == F.col("r_host")) & F.startswith("p_path", "r_path"), "left")
    rule = F.concat("r_host", "r_path")
    best = exact.groupBy(*same, "copies").agg(F.max(F.when(F.col("key").isNotNull(), F.struct(F.length(rule).alias("n"), F.col("r_verdict").alias("v"), rule.alias("k")))).alias("best"))
    found = best.select(F.col("p_id").alias(id_col), F.col("p_host").alias("host"), F.col("p_path").alias("path"), F.col("best.k").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return missed.unionByName(found)
