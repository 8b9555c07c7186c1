"""Array kernels over UTF-8 text batches: word boundaries, word hashes, shingle hashes.

Everything works on whole texts, in slices of a bounded number of bytes, so that memory depends on the slice and the
longest text only.  A word is a maximal run of bytes that are ASCII letters or digits, or bytes of non-ASCII characters;
ASCII letters are folded to lower case before hashing.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = True
WORD[0x41:0x5B] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit hashes."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.ones(1, _U)
            step = b
            while len(p) < size:
                p = np.concatenate([p, p * _U(step)])
                step = step * step & _MASK
            out.append(p)
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most ``most`` bytes, or one longer text."""
    raw, offsets = buffers(texts)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal true runs; a run never crosses from one text to the next."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """Polynomial hashes of any byte ranges of a slice, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((FOLD[data].astype(_U) + _U(1)) * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words of a slice, in order."""
    starts, ends, rows = runs(WORD[data], offsets)
    return Hasher(data)(starts, ends), rows


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all word shingles.  A text of one to ``size - 1`` words has one shingle, of all its words."""
    hashes, rows = words(data, offsets)
    n = len(hashes)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    out, at = [], []
    if n >= size:
        whole = rows[size - 1 :] == rows[: n - size + 1]
        got = np.zeros(n - size + 1, _U)
        for j in range(size):
            got += hashes[j : n - size + 1 + j] * _U((2 * j + 1) * 0xC2B2AE3D27D4EB4F & _MASK)
        out.append(mix(got[whole]))
        at.append(rows[: n - size + 1][whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        got = np.zeros(len(short), _U)
        for j in range(size - 1):
            have = count[short] > j
            got[have] += hashes[first[short][have] + j] * _U((2 * j + 1) * 0x165667B19E3779F9 & _MASK)
        out.append(mix(got + count[short].astype(_U)))
        at.append(short)
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def trim() -> None:
    """Give freed memory back to the system; an idle Python worker would hold it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, then ``trim``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return each


def strings(texts: pa.Array) -> list[str]:
    """Python strings; nulls count as empty."""
    return ["" if t is None else t for t in texts.to_pylist()]
