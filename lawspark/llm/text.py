"""Byte-level words of Arrow text batches, without a Python object per word.

A batch is cut into runs of whole texts of about ``SLICE`` bytes, so that the
numpy columns beside the bytes stay small; only a single longer text makes a
longer run. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)  # after lower-casing: 0-9, a-z and every non-ASCII byte
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE[LOWER]
_power = np.ones(1, np.uint64)
_unpower = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each, from 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes in all."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of texts: byte ranges and the text each lies in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which the table ``inside`` is true."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, n)
    m = inside[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(offsets, start, "right") - 1, n)


def prefix_sums(w: Words, lower: bool = True) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which any span's hash follows."""
    global _power, _unpower
    n = len(w.data)
    if len(_power) < n + 1:
        size = max(n + 1, SLICE + 1)
        _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _unpower = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[w.data] * _power[:n], out=prefix[1:])
    return prefix


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    raw = (prefix[end] - prefix[start]) * _unpower[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    return span_hashes(prefix_sums(w), w.start, w.end)


def ngrams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``k`` words of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = doc[:n] == doc[k - 1 :]
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return acc[whole], doc[:n][whole]
