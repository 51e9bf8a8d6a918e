"""Byte-level scanning of text columns with numpy.

Whole Arrow batches are handled as one byte buffer with document offsets. A
polynomial prefix hash modulo 2**64 over random byte codes gives the hash of
any byte range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are scanned at once; a longer text is scanned alone.
CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 3
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            if size > 1:
                p[1:] = U64(base)
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        power, self._inverse = _power_tables(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        terms = _CODES[buf]
        terms *= power[: len(buf)]
        np.cumsum(terms, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = self._sums[ends] - self._sums[starts]
        raw *= self._inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def fixed(self, width: int) -> np.ndarray:
        """Of every range of `width` bytes, by its start."""
        raw = self._sums[width:] - self._sums[:-width]
        raw *= self._inverse[: len(raw)]
        return mix(raw)


def flatten(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text starts and ends; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of at most `limit` bytes, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document counts of the maximal runs of bytes of a kind; none crosses documents."""
    n = len(buf)
    counts = np.zeros(len(off) - 1, np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    inside = kind[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, off)
    return starts, ends, np.diff(at)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram by its first word, and which of them lie in one document."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + hashes[j : total - n + 1 + j])
    ends = np.repeat(np.cumsum(counts), counts)[: total - n + 1]
    return out, np.arange(total - n + 1) + n <= ends
