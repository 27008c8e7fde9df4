"""Vectorised text helpers used inside Arrow batches.

Words are found on the UTF-8 bytes of a whole Arrow string column, never by a
Python loop over characters; a word is known by a 64-bit polynomial hash of its
bytes (finalised by a bit mixer).  Work is cut into slices of half a MB of text
at document boundaries, so memory is bounded by a slice plus one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit finaliser of a 64-bit hash (multiply / xor-shift)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` (mod 2**64) for i < n, kept and grown as needed."""
    if "f" not in _POW or len(_POW["f"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, b in (("f", _BASE), ("i", pow(_BASE, -1, 2 ** 64))):
            a = np.full(size, _U(b), np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["f"][:n], _POW["i"][:n]


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (nulls as empty) and the n+1 offsets of its rows."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1] if len(arr) \
        else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[offs[0]:offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some documents: byte range, row and hash of each; ``first[i]:first[i+1]`` are row i's."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.buf[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def split_words(buf: np.ndarray, offs: np.ndarray, lower: bool) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows that ``offs`` cuts out of ``buf``."""
    n = len(buf)
    if lower:
        buf = _LOWER[buf]
    inside = ~_SPACE[buf]
    head = np.zeros(n + 1, bool)
    head[offs] = True                      # a row's first byte never continues a word
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | head[:n]))
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~nxt | head[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start])
    return Words(buf, start, end, np.searchsorted(start, offs), h)


def word_slices(col, lower: bool, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of rows i..j) over a whole string column."""
    buf, offs = utf8(col)
    for i, j in slices(offs, limit):
        lo = offs[i]
        yield i, j, split_words(buf[lo:offs[j]], offs[i:j + 1] - lo, lower)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``width`` words inside one row."""
    n, counts = len(words.hash), np.diff(words.first)
    per = np.maximum(counts - width + 1, 0)
    if n < width or not per.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * _U(0xD6E8FEB86659FD93) + words.hash[k:n - width + 1 + k]
    row0 = np.repeat(words.first[:-1], per)
    at = row0 + np.arange(len(row0)) - np.repeat(np.cumsum(per) - per, per)
    return at, mix64(h[at])
