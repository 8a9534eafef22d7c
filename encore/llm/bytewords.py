"""Words of many texts at once, on their UTF-8 bytes, with 64-bit hashes.

Every separator of the word patterns used here is an ASCII byte, and no byte of
a longer UTF-8 character is one, so words can be cut on bytes. A word's hash is
its polynomial in an odd multiplier modulo 2^64, from prefix sums, then mixed.
Texts are handled in pieces of about `PIECE` bytes (a longer text is a piece of
its own), so memory follows the longest text and not the batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_KEEP = 1 << 20
_P = 0x9E3779B97F4A7C55                      # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE                           # words [^\x20\x09-\x0D]+
ALNUM = np.ones(256, bool)                   # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, 2 * PIECE)
    out = []
    for base in (_P, _PINV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= _KEEP:
        _powers[:] = out
    return out[0][:n], out[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


@dataclass
class Piece:
    """Texts `first` to `first + n - 1` of a batch. Text i has the bytes
    buf[at[i]:at[i+1]] and the words word_at[i] to word_at[i+1] - 1."""

    first: int
    n: int
    buf: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def word_spans(buf: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first."""
    inside = is_word[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[1:-1][at[1:-1] < len(buf)]
    begins[cuts] = inside[cuts]                  # a text's first byte begins a word even after a word byte
    stops = np.zeros(len(buf) + 1, bool)
    stops[1:] = inside
    stops[:-1][inside & ~begins] = False
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, at)


def pieces(texts: pa.Array, is_word: np.ndarray = NOT_SPACE, table: np.ndarray | None = None,
           size: int = PIECE) -> Iterator[Piece]:
    """`table` maps each byte first (LOWER, or None). Null is empty."""
    raw, at = _bytes_of(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        buf = raw[at[i]:at[j]]
        if table is not None:
            buf = table[buf]
        own = at[i:j + 1] - at[i]
        yield Piece(i, j - i, buf, own, *word_spans(buf, own, is_word))
        i = j
    # Arrow keeps what a batch has freed; several workers share an executor's memory
    pa.default_memory_pool().release_unused()


_COEF = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of `words`."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(k), np.uint64)
    for i in range(k):
        h += words[i:i + m] * _COEF[i % 64]
    return mix(h)


def text_windows(piece: Piece, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word, and hash, of every window of k words that
    lies in one text."""
    h = window_hashes(words, k)
    doc = piece.doc
    ok = np.flatnonzero(doc[:len(h)] == doc[k - 1:k - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    return ok, h[ok]
