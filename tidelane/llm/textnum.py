"""Words, lines and rolling hashes of Arrow string columns, in numpy.

Texts are read as UTF-8 bytes in blocks of whole documents. Words are runs of
bytes other than ASCII white space, the same as `[^\\x20\\x09-\\x0D]+` on the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _powers:
        for base in (BASE, INVERSE):
            p = np.full(BLOCK + 1, base & (2**64 - 1), U64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def prefix(values: np.ndarray, kind=np.int64) -> np.ndarray:
    out = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=out[1:])
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span, from one polynomial prefix sum modulo 2**64.
    Long data go piece by piece; spans may cross pieces."""
    pw, inv = powers()
    at_start, at_end = np.zeros(len(starts), U64), np.zeros(len(ends), U64)
    unpow = np.zeros(len(starts), U64)
    carry = U64(0)
    for s in range(0, max(len(data), 1), BLOCK):
        piece = data[s : s + BLOCK]
        n, last = len(piece), s + BLOCK >= len(data)
        p = np.empty(n + 1, U64)
        p[0] = 0
        np.cumsum(BYTE[piece] * pw[:n], out=p[1:])
        p = p * U64(pow(BASE, s, 1 << 64)) + carry
        for where, out in ((starts, at_start), (ends, at_end)):
            here = (where >= s) & ((where < s + n) | last) if len(data) > BLOCK else slice(None)
            out[here] = p[where[here] - s]
        here = (starts >= s) & ((starts < s + n) | last) if len(data) > BLOCK else slice(None)
        unpow[here] = inv[starts[here] - s] * U64(pow(INVERSE, s, 1 << 64))
        carry = p[-1]
    return mix((at_end - at_start) * unpow + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Block:
    """Some whole documents: bytes, offsets, and the words' spans, documents and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        space = SPACE[data]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        if len(data):
            full = offsets[:-1][offsets[1:] > offsets[:-1]]
            begin[full] = ~space[full]
            stop = offsets[1:][offsets[1:] > offsets[:-1]] - 1
            end[stop] = ~space[stop]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = self.doc_of(self.starts)
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.first_word = prefix(self.n_words)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def word_hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)

    def windows(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of n words that lies within one document.
        A window's hash is a rolling sum of its words' hashes times powers of BASE."""
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(words) - n + 1])
        h = np.zeros(len(words) - n + 1, U64)
        for k in range(n):
            h += words[k : len(words) - n + 1 + k] * U64(pow(BASE, k, 1 << 64))
        return at, mix(h[at])


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, Block]]:
    """Whole documents (null: empty), of about `most` bytes together, as (first, last + 1, Block)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
