"""Benchmark decontamination (operator 3): size-partitioned MinHash containment search.

Items are short and documents long, so Jaccard similarity says nothing; what
counts is the share of an item's shingles that a document contains.  The items
are partitioned by their number of shingles, and each partition has its own
sketch size: of an item with ``q`` shingles at most ``q - ceil(t q)`` may be
missing, so one more of its least hashes (a bottom-k MinHash sketch) is enough
for one of them to be in every document that contains the share ``t``.  The
search therefore misses nothing.  Hits are candidates, and exact containment of
the shingles, over the whole document, decides.

The sketch values are an index of the items.  Where it is small (all items
together have at most ``index_bound`` shingles, counted first) it goes to every
executor and a document is probed and verified where it is read, without a
shuffle.  A larger index is a table: the documents' shingles meet the sketches by
hash, and the shingles of the candidates are counted by joins, so nothing grows
on the driver or in a task, and the documents are read no more often.

Shingles are 64-bit hashes of their words; that two differ and have one hash is
the only way for a result to be wrong.

Defined results: words are runs of letters, digits and non-ASCII characters of
the lower-cased text; an item or a document with less than ``k`` words has one
shingle of all its words (such an item is found in longer documents with
``short_items``, which probes documents with runs of its number of words too),
and one without words matches nothing; items with equal text each give a row;
repeated documents stay repeated; null ids are kept; ids may be of any type; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.scratch import Scratch, fresh
from tidemark.llm.words import NO_WORD, shingles, spans


class Index:
    """Bottom-k sketches of items, by size partition, and all their shingles for verification."""

    def __init__(self, items: list[tuple[object, np.ndarray]], threshold: float):
        items = [(i, s) for i, s in items if len(s)]
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for _, s in items], np.int64)
        # Partitions by powers of two of the size; the sketch of a partition fits its largest item.
        sketches = []
        for n, (_, s) in enumerate(items):
            top = (1 << (len(s) - 1).bit_length()) if len(s) > 1 else 1
            k = min(len(s), max(top - math.ceil(threshold * top - 1e-9) + 1, int(self.sizes[n] - self.need[n] + 1)))
            sketches.append(np.sort(s)[:k])
        owner = lambda parts: np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        self.sketch, self.sketch_of = self._sorted(sketches, owner(sketches))
        whole = [s for _, s in items]
        self.all, self.all_of = self._sorted(whole, owner(whole))

    @staticmethod
    def _sorted(parts, owners):
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    @staticmethod
    def _owners(values, owners, probe):
        """Owners of the index values that are in ``probe``, once for each value."""
        left, right = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        hit = right > left
        if not hit.any():
            return np.zeros(0, np.int64)
        return np.concatenate([owners[a:b] for a, b in zip(left[hit], right[hit], strict=True)])

    def contained(self, own: np.ndarray):
        """(item, shingles found, shingles of the item) for items that a document with these shingles contains."""
        if not len(own) or not len(self.ids):
            return
        candidates = np.unique(self._owners(self.sketch, self.sketch_of, own))
        if len(candidates):
            found = np.bincount(self._owners(self.all, self.all_of, own), minlength=len(self.ids))
            for i in candidates[found[candidates] >= self.need[candidates]].tolist():
                yield self.ids[i], int(found[i]), int(self.sizes[i])


class Probes:
    """An index for each number of words that the items' shingles have."""

    def __init__(self, items: list[tuple[object, np.ndarray, int]], threshold: float):
        self.indexes = [(k, Index([(i, s) for i, s, own in items if own == k], threshold)) for k in sorted({own for _, _, own in items})]

    def contained(self, text: str | None):
        for k, index in self.indexes:
            yield from index.contained(shingles(text, k))


_ITEMS = pa.schema([("probe", pa.int32()), ("need", pa.int64()), ("sketch", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def _indexed(items: DataFrame, id_col: str, text_col: str, threshold: float, k: int, short_items: bool) -> DataFrame:
    """Items with words: ``item``, ``probe`` (words of a shingle that documents are probed with), ``need``, ``sketch``, ``shingles``."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                own = shingles(text, k)
                if len(own):
                    n = len(spans(text.lower().encode("utf-8", "replace"), NO_WORD)[0]) if short_items else k
                    one = Index([(0, own)], threshold)
                    at.append(i)
                    rows.append((min(k, n), int(one.need[0]), one.sketch.view(np.int64), own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ITEMS))], ["item", *_ITEMS.names])

    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, probe int, need long, sketch array<long>, shingles array<long>")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc_key``, which stands for a text, and ``text``."""
    return docs.select(_key(text_col).alias("doc_key"), F.col(text_col).alias("text"))


def _found_by_joins(docs: DataFrame, text_col: str, index: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_key, number, n_found) of the texts and items of a large index; ``index`` has a ``number`` for each item."""
    probes = [r["probe"] for r in index.select("probe").distinct().collect()]  # at most k

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for probe in probes:
                    own = shingles(text.as_py(), probe).view(np.int64)
                    for at in range(0, len(own), 50_000):
                        part = own[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), pa.binary()), pa.array([probe] * len(part), pa.int32()), pa.array(part)], ["doc_key", "probe", "hash"])

    texts = _texts(docs, text_col)
    own = scratch.table(texts.mapInArrow(run, "doc_key binary, probe int, hash long").distinct())
    sketches = index.select("number", "probe", F.explode("sketch").alias("hash"))
    candidates = own.join(sketches, ["probe", "hash"]).select("doc_key", "number").distinct()
    wanted = candidates.join(index, "number").select("doc_key", "number", "probe", "need", F.explode("shingles").alias("hash"))
    found = wanted.join(own, ["doc_key", "probe", "hash"]).groupBy("doc_key", "number", "need").agg(F.count("*").alias("n_found"))
    return found.filter("n_found >= need").select("doc_key", "number", "n_found")


def _search(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float, k: int, index_bound: int, short_items: bool):
    """The items as a list where they have at most ``index_bound`` shingles, and else as a table."""
    scratch = Scratch(docs.sparkSession)
    index = scratch.table(_indexed(items, item_id, item_text, threshold, k, short_items).withColumn("number", F.monotonically_increasing_id()))
    if (index.agg(F.sum(F.size("shingles"))).first()[0] or 0) > index_bound:
        return None, index, scratch
    return [(r["item"], np.array(r["shingles"], np.int64).view(np.uint64), r["probe"]) for r in index.select("item", "shingles", "probe").collect()], index, scratch


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, k: int = 5, index_bound: int = 4_000_000, short_items: bool = False) -> DataFrame:
    """One row for each document and item it contains: ids (the item's as ``item_<name>`` where both have one name), ``n_found``, ``n_shingles`` and ``containment`` (at least ``threshold``)."""
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id].dataType
    own, index, scratch = _search(docs, items, item_id, item_text, threshold, k, index_bound, short_items)
    if own is None:
        pairs = _found_by_joins(docs, text_col, index, scratch)
        rows = docs.select(F.col(id_col).alias("doc"), _key(text_col).alias("doc_key"))
        found = rows.join(pairs, "doc_key").join(index.select("number", "item", F.size("shingles").cast("long").alias("n_shingles")), "number")
    else:
        sent, arrow = docs.sparkSession.sparkContext.broadcast(own), to_arrow_type(item_kind)

        def run(batches):
            probes = Probes(sent.value, threshold)
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    for row in probes.contained(text.as_py()):
                        at.append(i)
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["doc", "item", "n_found", "n_shingles"])

        found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind.simpleString()}, item {item_kind.simpleString()}, n_found long, n_shingles long")
    name = item_id if item_id != id_col else f"item_{item_id}"
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(name), "n_found", "n_shingles", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, k: int = 5, index_bound: int = 4_000_000, short_items: bool = False) -> DataFrame:
    """The documents, with all their columns, that contain no item; no shuffle where the index is small."""
    own, index, scratch = _search(docs, items, item_id, item_text, threshold, k, index_bound, short_items)
    if own is None:
        (name,) = fresh(docs, "hit")
        hit = _found_by_joins(docs, text_col, index, scratch).select(F.col("doc_key").alias(name)).distinct()
        return docs.join(hit, _key(text_col) == F.col(name), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        probes = Probes(sent.value, threshold)
        for batch in batches:
            yield batch.filter(pa.array([next(probes.contained(x.as_py()), None) is None for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
