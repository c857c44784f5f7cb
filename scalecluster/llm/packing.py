"""Packing of token sequences as a cutting-stock problem.

A document of n ids is cut into pieces of ``capacity`` ids and a tail.  Pieces
of the same length are alike, so the problem is a histogram of ``capacity``
numbers at most, whatever the corpus.  Column generation solves its linear
program (fewest sequences): a revised simplex over patterns, which starts from
greedy patterns; new ones are priced by a knapsack dynamic program over the dual values.  The rounded-down
solution's patterns are repeated as often as it says; what rounding leaves (at
most some patterns' worth) is packed best fit decreasing into patterns of its
own.  Documents are then ranked within their class, and a rank determines the
pattern, the repetition and the slot in it; offsets are sums within a sequence.

Ranks come from counts of (class, bucket) groups of bounded size, added up in
blocks, so a length that holds a third of the corpus isn't gathered in one task.

Defined cases: a null or empty text is one piece with the end id only; rows
with equal ids are separate documents, told apart by nothing but their pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import totals_before
from ..scratch import materialise
from ..session import map_arrow
from .bpe import ENCODE_BYTES, default_vocabulary, encoder
from .textkit import pieces, spans

CAPACITY = 1024
#: Column generation stops when the sequences exceed the lower bound by less.
GAP = 5e-4
MAX_COLUMNS = 6000
#: Patterns taken from one pricing.
PRICED = 32
#: Lengths are told apart exactly; with a coarser grain less than one grain is padded for each piece.
GRAIN = 1
RANK_GROUP = 1024


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``; docs has ``_id, _text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in pieces(batches, "_text", ENCODE_BYTES):
            ids, off = enc.encode(b.column(1))
            n = np.diff(off)
            number = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), number)
            start = spans(np.zeros(len(n), np.int64), number) * capacity
            length = np.minimum(n[row] - start, capacity)
            raw, at = memoryview(ids.astype("<u4").tobytes()), (off[row] + start) * 4
            parts = [raw[a:e] for a, e in zip(at.tolist(), (at + length * 4).tolist())]
            columns = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[row].astype(np.int64))]
            if with_ids:
                columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.transform(map_arrow, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int, columns: int = 1) -> tuple[float, list[np.ndarray]]:
    """Greatest value of a multiset of lengths within the capacity, and the
    counts of up to ``columns`` multisets: the best that hold some length, best first."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    within = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = best[c - lengths[: within[c]]] + values[: within[c]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], choice[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    out, covered = [], np.zeros(len(lengths), dtype=bool)
    for k in np.argsort(-(best[capacity - lengths] + values), kind="stable").tolist():
        if covered[k]:
            continue
        counts = np.zeros(len(lengths), dtype=np.int64)
        counts[k] = 1
        c = capacity - int(lengths[k])
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                counts[choice[c]] += 1
                c -= int(lengths[choice[c]])
        out.append(counts)
        covered |= counts > 0
        if len(out) == columns:
            break
    return float(best[capacity]), out


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivoting."""
    m = len(basis)
    both = np.hstack([basis.astype(float), np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0.0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def _improving(waiting: list[np.ndarray], duals: np.ndarray) -> np.ndarray | None:
    """Takes patterns from the end of the list until one improves the solution."""
    while waiting:
        column = waiting.pop()
        if duals @ column > 1 + 1e-7:
            return column
    return None


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one per column), their fractional use, and a lower bound.

    Greedy patterns come into the basis first, without pricing.  Dual values
    are smoothed towards those of the best bound, which steadies the sequence
    of priced patterns."""
    m = len(lengths)
    per = capacity // lengths
    basis = np.diag(per).astype(np.int64)
    inverse = np.diag(1.0 / per)
    use = demand / per
    bound, centre = float(lengths @ demand) / capacity, lengths / capacity
    waiting = first_patterns(lengths, demand, capacity)[::-1]
    for step in range(MAX_COLUMNS):
        if use.sum() <= bound * (1 + gap):
            break
        duals = inverse.sum(axis=0)
        column = _improving(waiting, duals)
        for smooth in (0.7, 0.0):
            if column is not None:
                break
            prices = np.maximum(smooth * centre + (1 - smooth) * duals, 0.0)
            value, found = knapsack(lengths, prices, capacity, PRICED)
            if (lower := float(prices @ demand) / max(value, 1e-12)) > bound:  # Farley's bound
                bound, centre = lower, prices / value
            waiting = found[::-1]
            column = _improving(waiting, duals)
        if column is None:
            break
        direction = inverse @ column
        positive = np.flatnonzero(direction > 1e-9)
        ratio = use[positive] / direction[positive]
        out = positive[ratio.argmin()]
        theta = max(float(ratio.min()), 0.0)
        use -= theta * direction
        use[out] = theta
        np.maximum(use, 0.0, out=use)
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        rows, columns = np.flatnonzero(direction), np.flatnonzero(pivot)
        if len(rows) * len(columns) < m * m // 4:
            inverse[np.ix_(rows, columns)] -= np.outer(direction[rows], pivot[columns])
        else:
            inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 500 == 499:
            inverse = _inverse(basis)
            use = np.maximum(inverse @ demand, 0.0)
    return basis, use, bound


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of one use each that hold the demand, best fit decreasing."""
    out: list[np.ndarray] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in range(len(lengths) - 1, -1, -1):
        size = int(lengths[k])
        left = int(demand[k])
        while left:
            room = next((r for r in range(size, capacity) if by_room[r]), 0)
            if room:
                i = by_room[room].pop()
            else:
                i, room = len(out), capacity
                out.append(np.zeros(len(lengths), dtype=np.int64))
            many = min(left, room // size)  # equal pieces go where the first of them went
            out[i][k] += many
            left -= many
            by_room[room - many * size].append(i)
    return out


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns to start from: the longest piece that is left, filled up by the
    longest that fit, repeated as often as the demand allows."""
    left, out = demand.copy(), []
    while (live := np.flatnonzero(left)).size:
        column, room = np.zeros(len(lengths), dtype=np.int64), capacity
        for k in live[::-1]:
            if lengths[live[0]] > room:
                break
            column[k] = min(room // lengths[k], left[k])
            room -= int(column[k] * lengths[k])
        used = np.flatnonzero(column)
        left -= column * int((left[used] // column[used]).min())
        out.append(column)
    return out


class Plan:
    """For each class of lengths the ranges of ranks and where they go.

    Class k holds the lengths (k - 1) * grain + 1 .. k * grain; patterns are
    made of classes, so what is in a pattern fits whatever its exact lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, gap: float = GAP):
        """histogram: pieces of each class; capacity in grains."""
        lengths = np.array(sorted(histogram), dtype=np.int64)
        demand = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
        patterns: list[tuple[int, np.ndarray]] = []
        self.bound = 0.0
        if len(lengths):
            basis, use, self.bound = column_generation(lengths, demand, capacity, gap)
            times = np.floor(use + 1e-7).astype(np.int64)
            left = demand.copy()
            for p in np.argsort(-times, kind="stable"):  # never more than the demand
                column = basis[:, p]
                t = int(min(times[p], (left[column > 0] // column[column > 0]).min()))
                if t > 0:
                    patterns.append((t, column))
                    left -= t * column
            patterns += [(1, c) for c in best_fit(lengths, left, capacity)]
        entries = []
        next_rank = dict.fromkeys(lengths.tolist(), 0)
        sequence = 0
        for times_used, column in patterns:
            slot = 0
            for k in np.flatnonzero(column)[::-1]:
                size, many = int(lengths[k]), int(column[k])
                entries.append((size, next_rank[size], many, sequence, slot))
                next_rank[size] += many * times_used
                slot += many
            sequence += times_used
        entries.sort()
        self.sequences = sequence
        self.length, self.rank, self.many, self.first, self.slot = np.array(entries, dtype=np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the rank-th piece (from 0) of a class."""
        scale = np.int64(1) << 50
        i = np.searchsorted(self.length * scale + self.rank, length * scale + rank, "right") - 1
        k = rank - self.rank[i]
        return self.first[i] + k // self.many[i], self.slot[i] + k % self.many[i]


def ranked(rows: DataFrame, histogram: dict[int, int], group: int = RANK_GROUP) -> DataFrame:
    """Adds ``_rank``, from 0 within each ``_class``, through groups of bounded size."""
    most = max(histogram, default=1)
    buckets = F.array(*[F.lit(max(1, -(-histogram.get(k, 0) // group))) for k in range(most + 1)])
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_salt"), F.get(buckets, F.col("_class").cast("int"))))
    sizes = rows.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = totals_before(sizes, ["_class"], "_bucket", "_n", "_sooner").drop("_n")
    own = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "_salt"))
    return rows.withColumn("_own", own).join(before, ["_class", "_bucket"]).withColumn("_rank", F.col("_sooner") + F.col("_own") - 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Sequences hold at most ``capacity`` ids and are filled from 0 without gaps;
    ``with_ids`` adds the piece's ids (little-endian uint32) for writers."""
    if capacity % grain:
        raise ValueError("the grain must divide the capacity")
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the salt tells equal rows apart; it's fixed once the pieces are written
    cut = token_pieces(docs, vocabulary or default_vocabulary(), capacity, with_ids).withColumn("_salt", F.monotonically_increasing_id())
    cut = materialise(cut.withColumn("_class", F.ceil(F.col("length") / grain)), "pieces")
    histogram = {r["_class"]: r.n for r in cut.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity / grain rows at most
    plan = Plan(histogram, capacity // grain)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, slot = plan.place(b.column("_class").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "_slot"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, _slot long"
    placed = ranked(cut, histogram).select(*names, "_class", "_rank").transform(map_arrow, run, schema)
    within = Window.partitionBy("sequence_id").orderBy("_slot")
    offset = (F.sum("length").over(within) - F.col("length")).alias("offset")
    return placed.select(*names[:5], "sequence_id", offset, *names[5:])
