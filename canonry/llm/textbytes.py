"""Vectorised word hashing over Arrow text columns, for the operators that run in tasks.

A batch of texts is one byte array; words, their 64-bit hashes and k-word window hashes
come from a few numpy passes over it, with no Python object per word. Working memory is
bounded by the chunk (``CHUNK_BYTES``, or one longer text), whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes \x20 and \x09-\x0D separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64 (kept per process)."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MULT, _INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def give_back() -> None:
    """Memory that this process has freed goes back to the system: Python workers live on between tasks, idle or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@dataclass
class Chunk:
    """Some consecutive texts of a batch: rows ``first .. first + n_docs``."""

    first: int
    data: np.ndarray      # uint8, the texts one after the other
    offsets: np.ndarray   # int64, n_docs + 1

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False,
           limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        part = data[offsets[at]: offsets[end]]
        yield Chunk(at, _LOWER[part] if lower else part, offsets[at: end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a chunk in order: byte range, 64-bit hash; ``first[d] .. first[d+1]`` are those of text d."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, by prefix sums of a polynomial modulo 2**64."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:-1], out=total[1:], dtype=np.uint64)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(chunk: Chunk) -> Words:
    """Words (maximal runs of bytes that are no white space) of every text of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    end = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    code = span_codes(data, start, end)
    first = np.searchsorted(start, offsets, side="left")
    return Words(start, end, code, first)


def window_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive codes (windows may cross texts: the caller masks those)."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= _MULT
        out += code[i: i + n]
    return mix(out)


def window_mask(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """True where the k-word window that starts at a word stays inside its text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= last[:n]
