"""Numpy views of Arrow text columns: bytes, word spans and span hashes.

Texts are handled as one UTF-8 byte buffer with offsets, so a task makes no
Python object per word. A word is ``[^\\x20\\x09-\\x0D]+``; its separators are
ASCII, so words are the same over bytes as over code points.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 21

_rng = np.random.RandomState(20240131)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_STEP_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Folds A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        a, b = np.full(m, _STEP, U), np.full(m, _STEP_INV, U)
        a[0] = b[0] = 1
        _powers = (np.multiply.accumulate(a), np.multiply.accumulate(b))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hasher:
    """Hashes of any spans of a byte buffer, from one pass of prefix sums."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power, self.inverse = _pow(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[buf] * power[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(x + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` bytes, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[:n] + U(width * 0xC2B2AE3D27D4EB4F % 2**64))


def as_large(column) -> pa.Array:
    """A string or binary column as one large_binary array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    return column.cast(pa.large_binary()).fill_null(b"")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def text_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of the slices of a text column."""
    buf, offsets = buffer_of(as_large(column))
    for i, j in slices(offsets, size):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of all words; words never cross texts."""
    w = np.zeros(len(buf) + 2, bool)
    w[1:-1] = IS_WORD[buf]
    begins = w[1:-1] & ~w[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(buf)]
    begins[cut] = w[1:-1][cut]  # a text may start right after a word
    starts = np.flatnonzero(begins)
    stops = w[1:-1] & ~w[2:]
    last = cut[cut > 0] - 1
    stops[last] = w[1:-1][last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hex_bytes(digests: list[bytes]) -> list[str]:
    return [d.hex() for d in digests]


def give_back() -> None:
    """Hand freed memory back to the system, where its C library can: Spark keeps Python workers between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_slices(batches, column: int, size: int = 4 * SLICE_BYTES):
    """Batches cut to rows that hold about ``size`` bytes of text."""
    for b in batches:
        _, offsets = buffer_of(as_large(b.column(column)))
        for i, j in slices(offsets, size):
            yield b.slice(i, j - i)


class BatchWords:
    """All words of a batch of texts, and its distinct words once.

    ``doc``, ``start`` and ``end`` are each word's text and place in ``buf``; ``of`` is its
    place among the distinct words, whose letters ``letters`` holds, lower-cased.
    """

    def __init__(self, column):
        self.buf, self.offsets = buffer_of(as_large(column))
        parts = []
        for i, j in slices(self.offsets):
            a = self.offsets[i]
            data = self.buf[a : self.offsets[j]]
            s, e, t = word_spans(data, self.offsets[i : j + 1] - a)
            parts.append((Hasher(data).spans(s, e), s + a, e + a, t + i))
        key, self.start, self.end, self.doc = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, U), *[np.zeros(0, np.int64)] * 3]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        rep = order[first]
        self.letters = letters_of(self.buf, self.start[rep], self.end[rep])


def letters_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The letters of each span, lower-cased."""
    if not len(starts):
        return []
    size = ends - starts
    out = np.full(int(size.sum()) + len(size), 10, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = buf[np.repeat(starts, size) + inside]
    text = out.tobytes()[:-1].decode("utf-8", "replace").lower()
    return _NOT_LETTERS.sub("", text).split("\n")


_NOT_LETTERS = re.compile(r"[^\w\n]|[\d_]")
