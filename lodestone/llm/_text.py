"""UTF-8 texts of Arrow batches as numpy arrays: blocks, words, lines and their 64-bit hashes.

All functions work on whole texts. A block holds whole documents, about ``BLOCK`` bytes of them or one longer
document, so memory follows the block and the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

# in tasks freed buffers go back to the system instead of a pool: a worker lives through many stages beside its executor
if TaskContext.get() is not None:
    pa.set_memory_pool(pa.system_memory_pool())

BLOCK = 1 << 19
U = np.uint64
#: ASCII white space: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Powers:
    """Powers of an odd base modulo 2^64, as many as the longest block so far needed."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = U(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table


_POWERS, _INVERSES = Powers(_BASE), Powers(_INVERSE)


class Hasher:
    """64-bit hashes of any slices of one byte array, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U)
        if len(data):
            np.cumsum((data.astype(U) + U(1)) * _POWERS.upto(len(data))[: len(data)], out=self.sums[1:])
        _INVERSES.upto(len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _INVERSES.table[start] + (end - start).astype(U))


class Block:
    """Some documents: rows ``first`` to ``first + n`` of a batch, their bytes ``data`` and bounds ``at`` (n + 1)."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray):
        self.first, self.data, self.at, self.n = first, data, at, len(at) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of ``flags`` (one a byte) by document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def words(self, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes other than ``apart`` (ASCII white space), and the bounds of each document's words (n + 1)."""
        word = ~apart[self.data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        inner = self.at[(self.at > 0) & (self.at < len(word))]
        before[inner] = False  # a document's first byte follows nothing
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[inner - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.at)


def blocks(column: pa.Array | pa.ChunkedArray, target: int = BLOCK) -> Iterator[Block]:
    """The texts of a string column, null as empty, in blocks; every row is in one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + target, side="right")) - 1)
        yield Block(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def runs(owner_bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of items dealt to owners by bounds: positions at which ``size`` items of one owner start, and those owners."""
    n = np.maximum(np.diff(owner_bounds) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.repeat(owner_bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first + np.arange(len(owner)), owner


def window_hash(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` successive word hashes from each position of ``at``."""
    h = np.zeros(len(at), U)
    for k in range(size):
        h = (h + words[at + k]) * U(0xD6E8FEB86659FD93 + 2 * k)
        h ^= h >> U(32)
    return mix(h)
