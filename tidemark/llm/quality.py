"""Quality classifier (operator 10): supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams (of code points, inside
words) are hashed into ``BUCKETS`` learned vectors.  A document is the mean of its
features' vectors, a softmax layer gives its score, and numpy stochastic
gradient descent trains both on a bounded sample of labelled rows.  As the
output is linear in the mean, a trained model is one number per bucket, a fixed
1 MB, and documents of any length are scored in blocks in bounded memory.

Scores come from the text alone.  Defined results: a null or empty text has no
features and gets the score of the bias; repeated rows stay repeated; without
any usable label every score is 0.5; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import BASE, WHITE, mix, word_hashes

BUCKETS, DIM = 1 << 17, 8
GRAMS = (3, 4, 5)
BLOCK = 1 << 20
#: Added to a hash so that features of different kinds differ.
KINDS = {"word": np.uint64(0x51), "pair": np.uint64(0x52), "same": np.uint64(0x53)}


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(text: str | None):
    """Yields arrays of buckets; together they are the text's features, repeated ones included."""
    data = (text or "").encode("utf-8", "replace")
    words, _, _ = word_hashes(data)
    if not len(words):
        return
    yield _bucket(words + KINDS["word"])
    pairs = words[:-1] * BASE + words[1:] + KINDS["pair"]
    # Words that repeat themselves are one feature, whichever word it is.
    yield _bucket(np.where(words[:-1] == words[1:], KINDS["same"], pairs))
    text = f" {text} "
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK + max(GRAMS) - 1].encode("utf-32-le", "replace"), np.uint32)
        part, white = points.astype(np.uint64), WHITE[np.minimum(points, 255)]
        for n in GRAMS:
            m = min(len(part) - n + 1, BLOCK)
            if m <= 0:
                continue
            value, inner = np.full(m, n, np.uint64), np.zeros(m, bool)
            for i in range(n):
                value = value * BASE + part[i : i + m]
                if 0 < i < n - 1:
                    inner |= white[i : i + m]
            yield _bucket(value[~inner])


class Model:
    """``weight`` of each bucket, and ``bias``, of the score's log odds."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in features(text):
            total += float(self.weight[part].sum())
            n += len(part)
        odds = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def train(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero."""
    if not texts:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for text in texts:
        parts = list(features(text))
        ids, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
        docs.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= np.float32(0.1) * step * p
            # Each feature moves by its share, scaled up as shares of a long text are tiny.
            vectors[ids] = own - (step * 8) * np.outer(share, back)
    to = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(vectors.astype(np.float64) @ to, float(bias[1] - bias[0]))


def fold(id_column: Column) -> Column:
    """Remainder by 4 of the CRC-32 of the id as text; 2 is held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_bytes: int) -> tuple[list[str], list[int]]:
    """At most ``max_rows`` labelled training rows, in the order of a hash of the id, of texts up to ``max_bytes``."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 2))
    drawn = usable.groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("l_label")).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
    # ``drawn`` has at most max_rows rows of two numbers, so it can be broadcast.
    rows = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("l_text")).filter(F.octet_length("l_text") <= max_bytes).join(F.broadcast(drawn), "l_id").groupBy("l_id").agg(F.min("l_text").alias("l_text"), F.max("l_label").alias("l_label"))
    got = sorted(rows.collect())
    return [r["l_text"] for r in got], [int(r["l_label"]) for r in got]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, max_bytes: int = 30_000) -> Model:
    return train(*sample(docs, labels, id_col, text_col, label_col, max_rows, max_bytes))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row: id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(x.as_py()) for x in batch.column(1)], pa.float64())], ["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose text scores ``threshold`` or more; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(x.as_py()) >= threshold for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
