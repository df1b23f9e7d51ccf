"""Words and word shingles as 64-bit hashes, computed with numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the hashes; any odd numbers do.
BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20

#: Bytes that end a word: ASCII white space (0x20, 0x09-0x0D).
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word for shingles: all of ASCII but letters, digits and the underscore.
NO_WORD = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grown(powers: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    while len(powers) < n:
        powers = np.concatenate([powers, powers * np.uint64(int(powers[-1]) * int(base) % (1 << 64))])
    return powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def spans(data: bytes, ends: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~ends[np.frombuffer(data, np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(data: bytes, ends: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word; the bytes are taken in blocks that end between words."""
    global _powers, _inverse
    first, last = spans(data, ends)
    if not len(first):
        return np.zeros(0, np.uint64), first, last
    hashes = np.empty(len(first), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + BLOCK, "right")))
        begin, n = int(first[i]), int(last[j - 1] - first[i])
        if len(_powers) < n + 1:
            _powers, _inverse = _grown(_powers, BASE, n + 1), _grown(_inverse, BASE_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[begin : begin + n].astype(np.uint64) + np.uint64(1)) * _powers[:n], out=sums[1:])
        a, b = first[i:j] - begin, last[i:j] - begin
        hashes[i:j] = mix((sums[b] - sums[a]) * _inverse[a] + (b - a).astype(np.uint64))
        i = j
    return hashes, first, last


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), BASE
    for i in range(k):
        out += hashes[i : i + n] * factor
        factor = np.uint64(int(factor) * int(MIX_A) % (1 << 64))
    return mix(out)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words of the lower-cased text.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    hashes, _, _ = word_hashes((text or "").lower().encode("utf-8", "replace"), NO_WORD)
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(k, len(hashes))))
