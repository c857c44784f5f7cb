"""Vectorised word splitting and hashing over Arrow batches.

All functions work on the UTF-8 bytes of a whole batch at once (numpy, no
per-row Python).  Null texts count as empty texts everywhere.  Memory is
bounded by the piece size given to ``pieces`` plus one document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SEGMENT = 1 << 18
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words, by word rule.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables = {"n": 0}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        n = max(n, SEGMENT + 1)
        _tables.update(n=n, up=_powers(BASE, n), down=_powers(BASE_INVERSE, n))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants), in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets into them (rows + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trimmer():
    """glibc's malloc_trim, or nothing elsewhere."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:
        return lambda _: 0


_trim = _trimmer()


def give_back() -> None:
    """Return freed memory to the system: workers stay for the next tasks, and
    what they keep is missing beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        give_back()
    give_back()


class Words:
    """Words of a batch: byte ``starts``/``ends``, and ``first`` (rows + 1):
    row r has the words first[r] .. first[r + 1] - 1."""

    def __init__(self, column: pa.Array, rule: np.ndarray, lower: bool):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        inside = rule[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        if len(inside):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        cuts = self.offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a word on both sides
        marks = np.flatnonzero(edge)
        if len(cuts):
            marks = np.sort(np.concatenate([marks, cuts, cuts]))
        self.starts, self.ends = marks[::2], marks[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.rows = len(self.offsets) - 1

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def fits(self, k: int) -> np.ndarray:
        """Positions at which k words of one row start."""
        n = len(self.starts)
        if n < k:
            return np.empty(0, np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return np.flatnonzero(left >= k)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    i = 0
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        size = int(ends[j - 1] - lo)
        up, down = _pow_tables(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[lo : lo + size]] * up[:size], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    out += (ends - starts).astype(np.uint64) * U64(BASE)
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int, steps: np.ndarray = STEP) -> np.ndarray:
    """Hashes of every k successive words, also across rows; see Words.fits.
    Other ``steps`` give other hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * steps[j]
    return mix(out)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def joined_words(words: Words, keep: np.ndarray, row_counts: bool = False):
    """Per row the kept words joined by one space, as list of bytes."""
    lengths = (words.ends - words.starts + 1)[keep]
    src = spans(words.starts[keep], lengths)
    at_end = np.cumsum(lengths) - 1
    np.minimum(src, max(len(words.data) - 1, 0), out=src)
    flat = words.data[src] if len(src) else np.empty(0, np.uint8)
    if len(flat):
        flat[at_end] = 0x20
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
    ends = np.concatenate([[0], np.cumsum(lengths)])[kept_before]
    raw = flat.tobytes()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
