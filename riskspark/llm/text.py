"""Whole-batch word and shingle hashing over Arrow string arrays (numpy, no per-word Python).

Words are maximal runs of bytes other than ``0x20`` and ``0x09``-``0x0D``; only ``A``-``Z`` are
lower-cased, so every step works on UTF-8 bytes. A word's 64-bit hash is a polynomial in an odd
base over a random table of byte values (prefix sums give every word of a slice at once) followed
by a finaliser; it depends on the word's bytes alone, so it agrees across batches and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes of text handled at a time (a single longer document is one slice of its own)
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_RAW = _BYTE.copy()
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        out = np.full(size, base & (2**64 - 1), np.uint64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``."""
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((_BYTE_LOW if lower else _BYTE_RAW)[data] * _power(_BASE, len(data), "up"), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power(_INVERSE, len(data) + 1, "down")[start]
    return mix(h + (end - start).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into (first row, end row, bytes, offsets) of about ``limit`` bytes, whole documents each."""
    data, off = buffers(texts)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


@dataclass
class Words:
    """Words of a slice of documents: byte spans, hashes and each document's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per document, plus one: index of its first word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    """Splits a slice (see ``slices``) into words at the bytes that ``breaks`` marks."""
    space = breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    h = span_hash(data, start, end, lower) if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, h, np.searchsorted(start, off))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every run of ``size`` words; a shorter document is one shingle."""
    n = np.diff(w.first)
    doc = w.doc
    place = np.arange(len(doc)) - w.first[doc]
    left = n[doc] - place
    total = np.zeros(len(doc), np.uint64)
    for j in range(min(size, len(doc))):
        part = np.zeros(len(doc), np.uint64)
        part[: len(doc) - j] = w.hash[j:] * _MULT[j]
        total += np.where(left > j, part, U64(0))
    keep = (left >= size) | ((place == 0) & (n[doc] < size))
    total = mix(total + np.minimum(left, size).astype(np.uint64))
    return doc[keep], total[keep]


def distinct_sorted(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per document in ascending order, and each document's range."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def span_of(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs ``h[start:end]`` of word hashes (order counts)."""
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h), "up"), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(h) + 1, "down")[start] + (end - start).astype(np.uint64))
