"""Numpy views of Arrow text batches: words, their hashes, and slices of bounded size.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. A word's hash is a 64-bit
polynomial over its bytes, finished with a bit mixer; equal words always get
equal hashes, and two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and others share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_made: dict[int, np.ndarray] = {}


def _powers(size: int, base: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, at least."""
    if base not in _made or len(_made[base]) < size:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _made[base] = np.cumprod(out, dtype=np.uint64)
    return _made[base]


def _room(n: int) -> int:
    return max(SLICE_BYTES, 1 << max(0, int(n).bit_length()))


@dataclass
class Words:
    """The words of some texts: data and offsets are bytes, the rest one entry a word."""

    first: int  # row of the batch that texts start at
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def bounds(self) -> np.ndarray:
        """For each text, its first word's index; one more entry for the end."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of at most SLICE_BYTES, or of one row. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Find and hash the words of one slice; lower maps A-Z to a-z first, space says which bytes part words."""
    if lower:
        data = LOWER[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    word = ~space[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    starts[full] = word[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_room(n), _BASE)[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_room(n), _UNBASE)[start]
    return Words(first, data, offsets, start, end, doc, mix(value + (end - start).astype(np.uint64)))


def words_of(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a batch's texts, a slice at a time."""
    for part in slices(texts):
        yield split_words(*part, lower=lower)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text row) of every run of ``size`` words; a text with fewer words gives its whole sequence once."""
    n = len(words.hash)
    counts, bounds = words.counts(), words.bounds()
    full = np.zeros(0, np.uint64)
    keep = np.zeros(0, np.int64)
    if n >= size:
        value = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            value = value * np.uint64(_BASE) + words.hash[i : n - size + 1 + i]
        keep = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
        full = mix(value[keep])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = counts[short] > i
            extra[has] = extra[has] * np.uint64(_BASE) + words.hash[bounds[short[has]] + i]
        hashes = np.concatenate([full, mix(extra + counts[short].astype(np.uint64))])
        rows = np.concatenate([words.doc[keep], short])
        order = np.argsort(rows, kind="stable")
        return hashes[order], rows[order]
    return full, words.doc[keep]


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, rows in order."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[first], r[first]
    return h, r
