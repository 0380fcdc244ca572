"""Words and their hashes from Arrow text columns, vectorised with numpy.

Used inside tasks.  A word is a run of bytes other than space and
``\\x09``-``\\x0D``.  Texts are taken in blocks of whole texts, so memory
follows the block (or the longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers 0..n."""
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


@dataclass
class Words:
    """The words of ``n_docs`` texts, one after the other.

    ``hashes``: a 64-bit hash per word; ``first``: per text (and once more at
    the end) the index of its first word; ``starts``, ``ends``: byte positions
    in ``data``.
    """

    data: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets (nulls as empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of ``most`` bytes together, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    """The words of texts ``lo`` to ``hi`` - 1."""
    at = offsets[lo : hi + 1] - offsets[lo]
    data = data[offsets[lo] : offsets[hi]]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64), none, none)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    after_space = np.empty(n, bool)
    after_space[0] = True
    after_space[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (after_space | edge[:-1]))
    before_space = np.empty(n, bool)
    before_space[-1] = True
    before_space[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (before_space | edge[1:])) + 1
    powers, inverse = _powers(1 << max(20, (n - 1).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mix(raw + (ends - starts).astype(np.uint64) * _STEP)
    return Words(data, hashes, np.searchsorted(starts, at), starts, ends)


def column_words(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its block's words) through a text column."""
    data, offsets = text_bytes(column)
    for lo, hi in blocks(offsets, most):
        yield lo, words(data, offsets, lo, hi)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words (across texts: drop those with ``inside_text``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += hashes[k : k + m]
    return mix(out)


def inside_text(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs of ``n`` words that lie in one text, and that text's number."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[doc] + within, doc
