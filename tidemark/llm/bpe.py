"""BPE encoding and decoding (operator 1).

Pre-tokens are merged with a segment tree over adjacent pair ranks: each leaf
holds ``rank << 32 | position`` of the pair that starts there, each inner node
the minimum of its children, so the root names the leftmost lowest-rank merge.
A merge changes two leaves and their paths to the root.  The tree has a fan-out
of ``FAN`` so that an ordinary word is one node and long runs stay logarithmic.

Defined results: a null text is the empty text (no ids, decoded text empty);
repeated rows give repeated result rows; further columns of the input are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

FAN = 16
NONE = 1 << 62
#: Entries that a worker remembers of each kind, as a bound on its memory.
MEMORY = 400_000
#: Unicode White_Space, fixed values of the tokenizer's ``\s``.
SPACES = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PairTree:
    """Minimum tree with point updates over ``keys``."""

    def __init__(self, keys: list[int]):
        self.levels = [keys]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    def root(self) -> int:
        return min(self.levels[-1], default=NONE)

    def update(self, at: int, key: int) -> None:
        levels = self.levels
        levels[0][at] = key
        for k in range(1, len(levels)):
            at //= FAN
            low = min(levels[k - 1][at * FAN : at * FAN + FAN])
            if levels[k][at] == low:
                return
            levels[k][at] = low


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the public JSON format."""

    def __init__(self, spec: str):
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in tokenizer["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.table = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.merged: list[int] = []
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merged.append(self.vocab[a + b])
            self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], rank << 32)
        chars = byte_characters()
        self.first = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not word:
            return []
        ids = [*map(self.first.__getitem__, word)]
        ids[-1] = self.last[word[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        merged, get = self.merged, self.pairs.get
        if n <= FAN:  # the tree is one node: its leaves can move up as pairs close
            keys = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
            while (best := min(keys)) < NONE:
                at = keys.index(best)
                new = merged[best >> 32]
                ids[at : at + 2] = (new,)
                del keys[at]
                try:
                    keys[at] = get(new << 32 | ids[at + 1], NONE)
                except IndexError:  # the merge took the last pair
                    if not keys:
                        break
                if at:
                    keys[at - 1] = get(ids[at - 1] << 32 | new, NONE)
            return ids
        keys = [get(ids[i] << 32 | ids[i + 1], NONE) | i for i in range(n - 1)]
        tree = PairTree(keys)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree.root()) < NONE:
            at = best & 0xFFFFFFFF
            gone = after[at]
            ids[at] = merged[best >> 32]
            ids[gone] = -1
            after[at] = nxt = after[gone]
            if gone < n - 1:
                tree.update(gone, NONE)
            if nxt < n:
                before[nxt] = at
                tree.update(at, get(ids[at] << 32 | ids[nxt], NONE) | at)
            else:
                tree.update(at, NONE)
            if (prev := before[at]) >= 0:
                tree.update(prev, get(ids[prev] << 32 | ids[at], NONE) | prev)
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        """Token strings joined as a tokenizer without a decoder joins them."""
        return " ".join(map(self.table.__getitem__, ids))


class Remembered(dict):
    """Values by ``make(key)``; holds at most twice ``most`` short keys, the ones in use for longest."""

    def __init__(self, make, most: int = MEMORY):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Chunks(Remembered):
    """Little-endian ids of texts without white space, put together from those of their pre-tokens."""

    def __init__(self, bpe: Bpe, pattern: str):
        super().__init__(self.ids)
        self.merge, self.find = bpe.merge, regex.compile(pattern).findall

    def ids(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return array("I", self.merge(chunk.encode())).tobytes()
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return self[chunk[:-1]] + self[chunk[-1]]
        words = self.find(chunk)
        if len(words) == 1:
            return array("I", self.merge(chunk.encode())).tobytes()
        return b"".join([self[x] for x in words])


def rare(text: str) -> bool:
    """Whether a text may hold characters that this Python's Unicode tables lack; then the library's own classes are asked."""
    return not text.isascii() and not text.replace("\n", " ").isprintable()


def library_split(pattern: str):
    """Pieces of a text that match ``pattern``, by the classes of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(pattern), "removed", invert=True)
    return lambda text: [piece for piece, _ in split.pre_tokenize_str(text)]


class WordBpe:
    """The word-end tokenizer: NFC, white space to one space, lower case, pieces with a word-end mark."""

    #: The tokenizer's own pattern, a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str):
        self.bpe = Bpe(spec)
        self.chunks = Chunks(self.bpe, self.PATTERN.replace(r"\s", SPACES))
        self.space = regex.compile(f"[{SPACES}]+")

    def rare_words(self, text: str) -> list[str]:
        from tokenizers import normalizers

        if not hasattr(self, "library"):
            self.library = library_split(self.PATTERN)
        return self.library(normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text))

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Lower case goes character by character, without the rule for a final sigma.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.bpe.split.split(text) if self.bpe.split and "<|" in text else [text]
        out = []
        for part in parts:
            special = self.bpe.special.get(part)
            if special is not None:
                out.append(array("I", [special]).tobytes())
            elif rare(part):
                out.extend(array("I", self.bpe.merge(w.encode())).tobytes() for w in self.rare_words(part))
            else:
                part = self.normal(part)
                # split() also breaks at U+001C to U+001F, which are no white space here.
                odd = "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part
                out.extend(map(self.chunks.__getitem__, self.space.split(part) if odd else part.split()))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return self.bpe.decode(array("I", packed))


_LOADED: dict[tuple, object] = {}


def loaded(kind, spec: str):
    """One instance of ``kind`` for each vocabulary and worker."""
    key = (kind, hashlib.sha256(spec.encode()).digest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(spec)
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's text (a fixed few MB) for the executors; only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """One row for each row: id, ``n_tokens``, digests of ids and decoded text, and on request both themselves.

    Row by row, without a shuffle.  ``ids`` is an array of int, ``decoded`` the
    decoder's text.
    """
    spec = vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def run(batches):
        coder = loaded(WordBpe, spec.value)
        for batch in batches:
            n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for text in batch.column(1):
                packed = coder.encode(text.as_py() or "")
                out = coder.decode(packed)
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(out.encode()).hexdigest())
                if keep_ids:
                    ids.append(array("i", packed))
                if keep_decoded:
                    decoded.append(out)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            if keep_decoded:
                columns.append(pa.array(decoded, pa.string()))
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_decoded
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
