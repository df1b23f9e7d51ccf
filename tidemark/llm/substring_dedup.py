"""Substring dedup (operator 8): suffix automata of reference shards.

A window is ``k`` consecutive words.  Words that any repeated window covers go.

An automaton of the whole corpus can't be broadcast, as it grows with the
corpus; so the reference is dealt into shards that a repeated window cannot
straddle.  Every window belongs to the least hash of its ``ANCHOR``-word runs,
so equal windows have equal anchors, and neighbouring windows with one anchor
travel together as a stretch:

1. Each text is cut into stretches; rows (anchor, content hash, place) meet by
   anchor.  A stretch whose content has several places is repeated as a whole.
   One that is alone under its anchor is not repeated.  Others are asked for.
2. The words asked for are taken from their texts and meet by anchor.  Each
   shard's suffix automaton holds its stretches with their weights; streaming a
   stretch through it gives matching statistics, and a position whose match of
   ``k`` words occurs elsewhere ends a repeated window.
3. Spans and texts meet by the text's digest, and each text is cut once.

An anchor with over ``SHARD`` distinct stretches is not built in one task: its
stretches are cut again by longer anchors (see ``anchors``) and meet under
these, as often as needed; the last one is the whole window, where only equal
windows meet, so every shard is bounded and an automaton decides in each.

Equal texts are one text with a weight.  Texts are dealt by their digest once
and kept in buckets, where steps 2 and 3 join them without another shuffle.

Defined results: a null text has no words; texts under ``k`` words lose
nothing; repeated rows are copies of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, fresh
from tidemark.llm.words import BASE, BASE_INVERSE, _grown, mix, windows, word_hashes

ANCHOR = 8
#: Windows in a stretch at most.
STRETCH = 256
#: Distinct stretches of an anchor that one task takes.
SHARD = 1000

WHOLE, ASKED, HOT = 0, 1, 2
#: Mark of a place whose content its batch has elsewhere too.
REPEATED = 1 << 62


def anchors(k: int) -> list[int]:
    """Words of an anchor: the usual one, a longer one for hot anchors, and the window."""
    first = min(ANCHOR, k)
    return sorted({first, (first + k) // 2, k})


class SuffixAutomaton:
    """Of several word sequences with weights; ``count`` is how often a state's words occur.

    A state is a number in flat arrays; its first transition is too, and only branching states have a table.
    """

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.count = array("i", [-1]), array("i", [0]), array("q", [0])

    def _state(self, length: int, count: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.count.append(count)
        self.link.append(0)
        return len(self.word) - 1

    def add(self, words: list[int], weight: int) -> None:
        ids, word, to, more, link, length, count = self.ids, self.word, self.to, self.more, self.link, self.length, self.count
        last = 0
        for w in [ids.setdefault(w, len(ids)) for w in words]:
            first = word[last]
            seen = to[last] if first == w else more[last].get(w, -1) if last in more else -1
            if seen >= 0:
                last = seen if length[seen] == length[last] + 1 else self._clone(last, seen, w)
                count[last] += weight
                continue
            new, p, q = self._state(length[last] + 1, weight), last, -1
            while p >= 0:
                if first < 0:
                    word[p], to[p] = w, new
                elif p in more:
                    own = more[p]
                    q = to[p] if first == w else own.get(w, -1)
                    if q >= 0:
                        break
                    own[w] = new
                elif first == w:
                    q = to[p]
                    break
                else:
                    more[p] = {w: new}
                p = link[p]
                first = word[p]
            if p >= 0:
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = new

    def _clone(self, p: int, q: int, w: int) -> int:
        word, to, more, link = self.word, self.to, self.more, self.link
        new = self._state(self.length[p] + 1, 0)
        word[new], to[new] = word[q], to[q]
        if q in more:
            more[new] = dict(more[q])
        link[new], link[q] = link[q], new
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = new
            elif p in more and more[p].get(w) == q:
                more[p][w] = new
            else:
                break
            p = link[p]
        return new

    def finish(self) -> None:
        """Adds every state's count to the state of its longest other suffix."""
        for s in np.argsort(np.asarray(self.length), kind="stable")[:0:-1].tolist():
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[int], k: int) -> list[int]:
        """Starts of the sequence's windows of ``k`` words that occur more than once."""
        ids, word, to, more, link, length, count = self.ids, self.word, self.to, self.more, self.link, self.length, self.count
        state, out = 0, []
        for i, w in enumerate([ids[w] for w in words]):
            state = to[state] if word[state] == w else more[state][w]
            while length[link[state]] >= k:
                state = link[state]
            if length[state] >= k and i >= k - 1 and count[state] > 1:
                out.append(i - k + 1)
        return out


def _runs(hashes: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of windows with one anchor, the least hash of their runs of ``anchor`` words."""
    n = len(hashes) - k + 1
    least = windows(hashes, anchor)
    span, have = k - anchor + 1, 1
    while have < span:  # least over ``span`` neighbours, by doubling
        by = min(have, span - have)
        least = np.minimum(least[:-by], least[by:])
        have += by
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[cut], cut, np.diff(np.r_[cut, n])


def stretches(hashes: np.ndarray, k: int):
    """Anchor, content hash, start and number of windows of each stretch."""
    least, cut, n = _runs(hashes, k, anchors(k)[0])
    if n.max() > STRETCH:
        parts = -(-n // STRETCH)
        least = np.repeat(least, parts)
        cut = np.concatenate([np.arange(a, a + m, STRETCH) for a, m in zip(cut, n, strict=True)])
        n = np.diff(np.r_[cut, len(hashes) - k + 1])
    ends = cut + n
    power, inverse = _grown(np.ones(1, np.uint64), BASE, len(hashes) + 1), _grown(np.ones(1, np.uint64), BASE_INVERSE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    content = mix((sums[ends + k - 1] - sums[cut]) * inverse[cut] + (ends - cut).astype(np.uint64))
    return least, content, cut, n


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace"))[0]


_ROWS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("key", pa.binary()), ("at", pa.int64())])


def _places(k: int):
    def run(batches):
        for batch in batches:
            seen, parts = set(), []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                hashes = _hashes(text.as_py())
                if len(hashes) < k:
                    continue
                anchor, content, start, n = stretches(hashes, k)
                parts.append((anchor, content, start << 16 | n, key))
            if parts:
                lengths = [len(x[0]) for x in parts]
                owner = np.repeat(np.arange(len(parts)), lengths)
                anchor, content, at = (np.concatenate([x[i] for x in parts]) for i in range(3))
                # What is repeated within the batch is known to be: one place goes to the anchor, marked, and the
                # others to tasks of their text.  So a passage of a third of all texts is a row for each batch.
                _, first, back, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
                repeated = count[back] > 1
                at = at.astype(np.int64) | np.where(repeated, REPEATED, 0)
                other = np.flatnonzero(repeated & (first[back] != np.arange(len(content))))
                anchor = anchor.view(np.int64).copy()
                anchor[other] = np.frombuffer(b"".join(x[3][:8] for x in parts), np.int64)[owner[other]]
                at[other] = -1 - (at[other] & ~np.int64(REPEATED))
                keys = pa.array([x[3] for x in parts], pa.binary()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content.view(np.int64)), keys, pa.array(at)], schema=_ROWS)

    return run


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_TOLD = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("kind", pa.int32()), ("weight", pa.int32())])
_ASKED = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("weight", pa.int32()), ("words", pa.binary())])
_MATCHED = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("kind", pa.int32()), ("weight", pa.int32())])


class _Anchor:
    """The stretches of one anchor in the order of their contents; holds at most SHARD of them."""

    def __init__(self, anchor: int):
        self.anchor, self.content, self.hot, self.held = anchor, None, False, []

    def add(self, content: int, key: bytes, at: int, weight: int):
        if content == self.content:
            own = self.held[-1]
            if own[2] == 1 and (weight == 2 or (key, at) != (own[0], own[1])):
                own[2] = 2
                yield self.anchor, own[0], own[1], WHOLE, 2
            if own[2] == 2:
                yield self.anchor, key, at, WHOLE, 2
            return
        if len(self.held) >= SHARD:
            self.hot = True
            yield from self.told()
        self.content = content
        self.held.append([key, at, weight])
        if weight == 2:
            yield self.anchor, key, at, WHOLE, 2

    def told(self):
        kind = HOT if self.hot else ASKED
        yield from ((self.anchor, key, at, kind, weight) for key, at, weight in self.held)
        self.held = []

    def end(self):
        if self.hot or len(self.held) > 1:
            yield from self.told()


def _classify(batches):
    """From rows sorted by anchor and content: places that are repeated as a whole, and those to ask for."""
    group, out = None, []
    for batch in batches:
        anchors, contents, ats = (batch.column(i).to_numpy() for i in (0, 1, 3))
        keys = batch.column(2)
        known = ats < 0
        out += [(0, keys[i].as_py(), -1 - int(ats[i]), WHOLE, 2) for i in np.flatnonzero(known).tolist()]
        weights = np.where(~known & (ats & REPEATED != 0), 2, 1)
        ats = ats & ~np.int64(REPEATED)
        # Rows alone under their anchor are skipped at once; those at a batch's edge go the long way.
        same = anchors[1:] == anchors[:-1]
        for i in np.flatnonzero(~known & (np.r_[True, same] | np.r_[same, True] | (weights == 2))).tolist():
            if group is None or group.anchor != anchors[i]:
                if group is not None:
                    out.extend(group.end())
                group = _Anchor(int(anchors[i]))
            out.extend(group.add(int(contents[i]), keys[i].as_py(), int(ats[i]), int(weights[i])))
            if len(out) > 20_000:
                yield _batch(out, _TOLD)
                out = []
    if group is not None:
        out.extend(group.end())
    yield _batch(out, _TOLD)


def _words(k: int, level: int):
    """The words of the stretches that are asked for; a hot one's are cut by the anchors of ``level``."""
    anchor, seed = anchors(k)[level], np.uint64(level + 1)

    def run(batches):
        rows = []
        for batch in batches:
            for key, text, asked in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                key, hashes = key.as_py(), _hashes(text.as_py())
                for x in asked.as_py():
                    start, n = x["at"] >> 16, x["at"] & 0xFFFF
                    if x["kind"] == HOT:
                        least, cut, count = _runs(hashes[start : start + n + k - 1], k, anchor)
                        for own, a, m in zip(mix(least ^ seed).view(np.int64).tolist(), (start + cut).tolist(), count.tolist(), strict=True):
                            rows.append((own, key, a << 16 | m, x["weight"], hashes[a : a + m + k - 1].tobytes()))
                    else:
                        rows.append((x["anchor"], key, x["at"], x["weight"], hashes[start : start + n + k - 1].tobytes()))
                    if len(rows) > 5000:
                        yield _batch(rows, _ASKED)
                        rows = []
        yield _batch(rows, _ASKED)

    return run


def _match(k: int, last: bool):
    """Repeated windows of each anchor's stretches, by the shard's automaton; rows are sorted by anchor and words.

    Stretches of an anchor with more than SHARD of them are given as HOT, except at the ``last`` level.
    """

    def shard(rows):
        if len(rows) == 1:
            key, at, weight, _ = rows[0]
            if weight > 1:
                yield key, at, WHOLE, 2
            return
        automaton = SuffixAutomaton()
        rows = [(key, at, weight, np.frombuffer(words, np.uint64).tolist()) for key, at, weight, words in rows]
        for _, _, weight, words in rows:
            automaton.add(words, weight)
        automaton.finish()
        for key, at, _, words in rows:
            found = np.array(automaton.repeated(words, k), np.int64)
            if len(found):
                cut = np.flatnonzero(np.r_[True, np.diff(found) > 1])
                for a, n in zip(found[cut].tolist(), np.diff(np.r_[cut, len(found)]).tolist(), strict=True):
                    yield key, ((at >> 16) + a) << 16 | n, WHOLE, 2

    def again(rows):
        return [(key, at, HOT, weight) for key, at, weight, _ in rows]

    def run(batches):
        anchor, rows, hot, out = None, [], False, []
        for batch in batches:
            for own, key, at, weight, words in zip(*(batch.column(i) for i in range(5)), strict=True):
                own, row = own.as_py(), [key.as_py(), at.as_py(), weight.as_py(), words.as_py()]
                if own != anchor:
                    out.extend(again(rows) if hot else shard(rows) if rows else ())
                    anchor, rows, hot = own, [], False
                if rows and rows[-1][3] == row[3]:  # equal words are neighbours: one is kept, with a weight
                    rows[-1][2] = 2
                    out.append((row[0], row[1], WHOLE, 2))
                else:
                    if len(rows) >= SHARD and not last:
                        hot = True
                    if hot and rows:
                        out.extend(again(rows))
                        rows = []
                    rows.append(row)
            if len(out) > 20_000:
                yield _batch(out, _MATCHED)
                out = []
        out.extend(again(rows) if hot else shard(rows) if rows else ())
        yield _batch(out, _MATCHED)

    return run


def covered(hashes: np.ndarray, k: int, spans: list[int], copies: int) -> np.ndarray:
    """For each word whether a repeated window covers it."""
    n = len(hashes)
    gone = np.zeros(n, bool)
    if n < k:
        return gone
    if copies > 1:
        return ~gone
    edge = np.zeros(n + 1, np.int64)
    for at in spans:
        start = at >> 16
        edge[start] += 1
        edge[start + (at & 0xFFFF) + k - 1] -= 1
    own = windows(hashes, k)
    _, back, count = np.unique(own, return_inverse=True, return_counts=True)
    if len(count) < len(own):
        starts = np.flatnonzero(count[back] > 1)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(k: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            total, removed, digests, kept = [], [], [], []
            for text, copies, spans in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = text.as_py() or ""
                data = text.encode("utf-8", "replace")
                hashes, first, last = word_hashes(data)
                gone = covered(hashes, k, spans.as_py() or [], copies.as_py())
                stay = np.flatnonzero(~gone)
                total.append(len(hashes))
                removed.append(int(gone.sum()))
                words = data.split() if not len(gone) or not gone.any() else [data[first[i] : last[i]] for i in stay.tolist()]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if keep_text:
                    if removed[-1]:  # runs of kept words keep the white space between them
                        cut = np.flatnonzero(np.r_[True, np.diff(stay) > 1]) if len(stay) else stay
                        ends = np.r_[cut[1:], len(stay)] if len(stay) else stay
                        text = " ".join(data[first[stay[a]] : last[stay[b - 1]]].decode("utf-8", "replace") for a, b in zip(cut, ends, strict=True))
                    kept.append(text)
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, ["key", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    return run


def text_key(text: Column) -> Column:
    """Digest that stands for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def cut_texts(docs: DataFrame, text_col: str = "text", k: int = 35, keep_text: bool = True) -> DataFrame:
    """One row for each distinct text: ``key`` (see text_key), ``n_words``, ``n_removed``, ``kept_sha256`` and, on request, ``kept``."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = scratch.buckets(base.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "key")

    places = base.mapInArrow(_places(k), "anchor long, content long, key binary, at long")
    told = places.repartition("anchor").sortWithinPartitions("anchor", "content", "key", "at").mapInArrow(_classify, "anchor long, key binary, at long, kind int, weight int")
    told = scratch.table(told)
    asked = told.filter(F.col("kind") != WHOLE)
    spans = told.filter(F.col("kind") == WHOLE).select("key", "at")
    levels = range(1, len(anchors(k)))
    for level in levels or [0]:
        listed = asked.groupBy("key").agg(F.collect_set(F.struct("anchor", "at", "kind", "weight")).alias("asked"))
        words = texts.join(listed.hint("shuffle_merge"), "key").select("key", "text", "asked").mapInArrow(_words(k, level), "anchor long, key binary, at long, weight int, words binary")
        matched = words.repartition("anchor").sortWithinPartitions("anchor", "words", "key", "at").mapInArrow(_match(k, level == max(levels, default=0)), "key binary, at long, kind int, weight int")
        matched = scratch.table(matched)
        spans = spans.unionByName(matched.filter(F.col("kind") == WHOLE).select("key", "at"))
        asked = matched.filter(F.col("kind") == HOT).withColumn("anchor", F.lit(0).cast("long"))
        if asked.isEmpty():
            break
    spans = spans.groupBy("key").agg(F.collect_set("at").alias("spans"))
    joined = texts.join(spans.hint("shuffle_merge"), "key", "left").select("key", "text", "copies", "spans")
    return joined.mapInArrow(_cut(k, keep_text), "key binary, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, keep_text: bool = True) -> DataFrame:
    """One row for each row: id, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space and, on request, the ``kept`` text."""
    results = cut_texts(docs, text_col, k, keep_text)
    ids = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("key"))
    joined = ids.join(results, "key").drop("key")
    return joined.select(F.col("_id").alias(id_col), *joined.columns[1:])


def replace_texts(docs: DataFrame, text_col: str = "text", length_col: str | None = None, k: int = 35) -> DataFrame:
    """The documents, with all their columns, with repeated spans cut from the text; ``length_col`` gets its new length."""
    key, cut = fresh(docs, "key", "cut")
    results = cut_texts(docs, text_col, k).select(F.col("key").alias(key), F.col("kept").alias(cut))
    joined = docs.withColumn(key, text_key(F.col(text_col))).drop(text_col).join(results, key)
    new = {text_col: F.col(cut)} | ({length_col: F.length(cut).cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
