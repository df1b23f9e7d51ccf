"""Token counts (operator 4).

Pieces are counted once for each distinct pre-token and joined to the
per-document pre-token frequencies; ids are never built.

1. Runs of documents are cut into pre-tokens.  Frequencies of pre-tokens that
   are one piece by the fixed vocabulary are summed on the spot; the others
   become one row for each run and distinct pre-token, with the run's postings
   (document position, frequency) packed.
2. These rows meet by pre-token, sorted, so each distinct pre-token is counted
   once; its pieces times frequencies are added up for each run.
3. The sums of a run meet by run and give one row for each document.

No step holds more than a run (at most ``RUN`` documents) or one pre-token's
postings of one run, and a frequent pre-token has one row in each run.  Pre-tokens
meet within ``TOGETHER`` input partitions, so that the one with most postings is
many tasks (and is counted once in each).

A run's documents are numbered by their place, so a partition is put in an order
of its own first: a task that is run again, after a lost executor, then cuts the
same runs whatever order its input has that time.

Defined results: a null text is empty (no bytes, no tokens); each input row
gives a row, repeated or not; ids may be of any type that a string can be cast
to and from; other columns are ignored.
"""

from __future__ import annotations

import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import SPACES, Bpe, byte_characters, library_split, loaded, rare, vocabulary

#: Documents and distinct pre-tokens after which a run ends.
RUN, DISTINCT = 1 << 16, 250_000
#: Input partitions whose pre-tokens meet, a power of two.
TOGETHER = 64
#: Sums that a task holds before it adds them up or hands them on.
HELD = 4_000_000
#: A posting is position << SHIFT | frequency.
SHIFT, MOST = 12, (1 << 12) - 1
#: The byte-level tokenizer's own pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PreTokens:
    """Pre-tokens of a byte-level tokenizer, and those that are one piece."""

    def __init__(self, spec: str):
        self.bpe = Bpe(spec)
        self.plain = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")).findall
        self.library = library_split(PATTERN)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.single = set()
        for name in self.bpe.vocab:
            raw = bytes(back[c] for c in name)
            if len(self.bpe.merge(raw)) == 1:
                try:
                    self.single.add(raw.decode())
                except UnicodeDecodeError:
                    pass

    def find(self, text: str) -> list[str]:
        return self.library(text) if rare(text) else self.plain(text)

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens between them."""
        if self.bpe.split and "<|" in text:
            words: list[str] = []
            special = 0
            for part in self.bpe.split.split(text):
                if part in self.bpe.special:
                    special += 1
                else:
                    words += self.find(part)
            return words, special
        return self.find(text), 0


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``)."""
    spec = vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = "key string, run long, payload binary"
    arrow = pa.schema([("key", pa.string()), ("run", pa.int64()), ("payload", pa.binary())])

    def cut(batches):
        tool = loaded(PreTokens, spec.value)
        base, runs = TaskContext.get().partitionId() << 32, 0
        heads: list[tuple] = []
        postings: dict[str, array] = {}

        def flush():
            nonlocal heads, postings, runs
            run = base + runs
            runs += 1
            head = pa.RecordBatch.from_arrays([pa.array([x[0] for x in heads], pa.string()), pa.array([x[1] for x in heads], pa.int64()), pa.array([x[2] for x in heads], pa.int64())], ["id", "bytes", "known"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            # The run's own documents travel under a key that no pre-token has.
            keys = [f"\0{run}", *postings]
            values = [sink.getvalue().to_pybytes(), *(x.tobytes() for x in postings.values())]
            heads, postings = [], {}
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([run] * len(part), pa.int64()), pa.array(values[i : i + 20_000], pa.binary())], schema=arrow)

        single = tool.single
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                words, known = tool.of(text)
                at = len(heads) << SHIFT
                for word, n in Counter(words).items():
                    if word in single:
                        known += n
                        continue
                    own = postings.get(word)
                    if own is None:
                        own = postings[word] = array("I")
                    while n > MOST:
                        own.append(at | MOST)
                        n -= MOST
                    own.append(at | n)
                heads.append((doc.as_py(), len(text.encode()), known))
                if len(heads) >= RUN or len(postings) >= DISTINCT:
                    yield from flush()
        if heads:
            yield from flush()

    def count(batches):
        tool = loaded(PreTokens, spec.value)
        last, pieces = None, 0
        slots: dict[int, int] = {}  # of runs
        places, sums, held = [], [], 0

        def added():
            """The sums so far by place, which is the run's slot and the document's position."""
            place, value = np.concatenate(places), np.concatenate(sums)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            return place[first], np.add.reduceat(value, first)

        def flush():
            place, value = added()
            runs = {slot: run for run, slot in slots.items()}
            cut = np.flatnonzero(np.r_[True, (place[1:] >> 32) != (place[:-1] >> 32)])
            for i, j in zip(cut, [*cut[1:], len(place)], strict=True):
                at = (place[i:j] & 0xFFFFFFFF).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([runs[int(place[i] >> 32)]], pa.int64()), pa.array([struct.pack("<I", len(at)) + at.tobytes() + value[i:j].astype("<u4").tobytes()], pa.binary())], schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            own = np.array([k[:1] == "\0" and k == f"\0{run}" for k, run in zip(keys, batch.column(1).to_pylist(), strict=True)])
            if own.any():
                heads = batch.filter(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(["\0"] * heads.num_rows, pa.string()), heads.column(1), heads.column(2)], schema=arrow)
                batch = batch.filter(pa.array(~own))
                keys = [k for k, x in zip(keys, own, strict=True) if not x]
                if not keys:
                    continue
            counts = []
            for key in keys:
                if key != last:
                    last, pieces = key, len(tool.bpe.merge(key.encode()))
                counts.append(pieces)
            payload = batch.column(2)
            _, offsets, data = payload.buffers()
            bounds = np.frombuffer(offsets, np.int32)[payload.offset : payload.offset + len(payload) + 1]
            posting = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<u4").astype(np.int64)
            each = np.diff(bounds) // 4
            slot = np.array([slots.setdefault(run, len(slots)) for run in batch.column(1).to_pylist()], np.int64)
            places.append(np.repeat(slot, each) << 32 | posting >> SHIFT)
            sums.append((posting & MOST) * np.repeat(np.array(counts, np.int64), each))
            held += len(posting)
            if held > HELD:
                place, value = added()
                places, sums, held = [place], [value], len(place)
                if held > HELD // 2:
                    yield from flush()
                    slots, places, sums, held = {}, [], [], 0
        if held:
            yield from flush()

    def total(batches):
        run, head, sums = None, None, None

        def flush():
            n = head.column("known").to_numpy() + sums[: head.num_rows]
            yield pa.RecordBatch.from_arrays([head.column("id").combine_chunks(), head.column("bytes").combine_chunks(), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

        for batch in batches:
            for key, own, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                key, own, payload = key.as_py(), own.as_py(), payload.as_py()
                if own != run:
                    if head is not None:
                        yield from flush()
                    run, head, sums = own, None, np.zeros(1 << 17, np.int64)
                if key == "\0":
                    head = pa.ipc.open_stream(payload).read_all()
                else:
                    n = struct.unpack_from("<I", payload)[0]
                    sums[np.frombuffer(payload, "<u4", n, 4)] += np.frombuffer(payload, "<u4", n, 4 + 4 * n)
        if head is not None:
            yield from flush()

    stable = plain.sortWithinPartitions(F.xxhash64("id", "text"), "id", "text")
    part = F.shiftright("run", 31 + TOGETHER.bit_length())
    met = stable.mapInArrow(cut, rows).repartition("key", part).sortWithinPartitions("key").mapInArrow(count, rows)
    summed = met.repartition("run").sortWithinPartitions("run").mapInArrow(total, "id string, n_bytes long, n_tokens long")
    return summed.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
