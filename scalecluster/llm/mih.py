"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are rotated and reduced to BITS sign bits.  The rotations are learned on
a bounded sample (principal axes, then iterative quantisation, which turns them
so that signs lose least).  A code is cut into m substrings, and each position
has an index: rows are dealt out by the first bits of the substring there.  For
a Hamming radius, a code within it must, by the pigeonhole principle, have a
substring within its share of the radius; a query is sent to every bucket of
every position that holds such substrings.  There the substrings, then the
whole codes are compared, so every code within the radius is retrieved, in the
first position that qualifies only, and its vector is reranked by exact cosine
in double precision.  A bucket passes on k rows a query.

The radius is measured, not guessed: for CHECKED rows the true neighbours among
*all* rows are found by brute force in one scan, and their codes lie within the
radius for all but ``MISS`` of them.  So it shrinks as neighbours get nearer in a
larger table.  Queries that find fewer than k rows go again with twice the
radius, until it holds all codes.  m is the number of substrings with the least
expected share of rows to look at; the answer doesn't depend on it.

At scale: the table is scanned three times and shuffled m times; neither rows
nor queries pass through the driver.  Buckets with many rows or many queries are
split into blocks of bounded size on either side, so equal vectors, even a third
of all, don't meet in one task.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those of another length than most of the others
have (the greater length if two are as frequent); rows with a null id take no
part.  Rows with equal ids are separate candidates, but none of them answers
that id's query; queries with equal ids have a list each.  Ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from ..session import map_arrow, ship_package

BITS = 256
SAMPLE, CHECKED = 4096, 64
MISS = 0.02
K = 5
#: Rows and queries that meet in one task at a time, at most.
ROW_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 12
#: Substrings of a code to choose from, and bits of a bucket's number at most.
PARTS, PREFIX_BITS = (2, 4, 8, 16), 14


def takes_part(vector: Column) -> Column:
    """Whether a vector holds finite numbers only, and one that isn't 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows in double precision, each scaled by a power of two (which is exact
    and leaves cosines as they are) so that squares neither over- nor underflow."""
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    far = np.abs(exponent) > 200
    return np.ldexp(x, -exponent[:, None]) if far.any() else x


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def learn_axes(sample: np.ndarray, bits: int = BITS, seed: int = 17, rounds: int = 20) -> np.ndarray:
    """(width, bits): columns whose products' signs are the code."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = sample / norms(sample)[:, None]
    width, parts, left = sample.shape[1], [], bits
    while left:
        take = min(width, left)
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :take]
        turn = np.linalg.qr(rng.normal(size=(take, take)))[0]
        v = x @ axes
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (a @ b).T
        parts.append(axes @ turn)
        left -= take
    return np.concatenate(parts, axis=1)


def encode(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(rows, bits / 8) bytes."""
    return np.packbits(x @ axes >= 0, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the byte rows of a and b (or one row b)."""
    kind = next(t for t in (np.uint64, np.uint32, np.uint16, np.uint8) if a.shape[1] % np.dtype(t).itemsize == 0)
    return np.bitwise_count(np.ascontiguousarray(a).view(kind) ^ np.ascontiguousarray(b).view(kind)).sum(axis=-1, dtype=np.int64)


class Index:
    """How codes are cut: m substrings, each one's share of the radius, and the
    bits that number its buckets."""

    def __init__(self, radius: int, bits: int, m: int, prefix: int):
        self.radius, self.m, self.size = radius, m, bits // m
        self.prefix = min(prefix, self.size)
        total = radius - m + 1  # the shares add up to this, so one of them must hold
        self.share = [total // m + (p < total % m) for p in range(m)]

    @classmethod
    def choose(cls, radius: int, bits: int, n: int) -> Index:
        prefix = min(PREFIX_BITS, max(0, ceil(log2(max(1, n / ROW_BLOCK)))))
        return min((cls(radius, bits, m, prefix) for m in PARTS if bits % (8 * m) == 0), key=cls.cost)

    def cost(self) -> float:
        """Expected share of all rows that a query looks at, and copies of rows."""
        reached = [sum(comb(self.prefix, i) for i in range(min(s, self.prefix) + 1)) / 2**self.prefix for s in self.share]
        return sum(reached) + 0.02 * self.m

    def part(self, code: np.ndarray, p: int) -> np.ndarray:
        return code[:, p * self.size // 8 : (p + 1) * self.size // 8]

    def bucket(self, code: np.ndarray, p: int) -> np.ndarray:
        head = self.part(code, p)[:, :2].astype(np.int64)
        value = head[:, 0] << 8 | (head[:, 1] if head.shape[1] > 1 else 0)
        return value >> (16 - self.prefix)

    def reach(self, p: int) -> np.ndarray:
        """What a bucket number may differ by from that of a query."""
        every = np.arange(1 << self.prefix)
        return every[np.bitwise_count(every) <= self.share[p]]

    def candidates(self, codes: np.ndarray, code: np.ndarray, p: int) -> np.ndarray:
        """Rows within the radius for which p is the first position that qualifies."""
        at = np.flatnonzero(distance(self.part(codes, p), self.part(code, p)) <= self.share[p])
        at = at[distance(codes[at], code) <= self.radius]
        for q in range(p):
            at = at[distance(self.part(codes[at], q), self.part(code, q)) > self.share[q]]
        return at


def _usual_width(rows: DataFrame) -> tuple[int, int]:
    """The most frequent length and its number of rows."""
    usual = rows.groupBy(F.size("_v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return (usual.width, usual.n) if usual else (0, 0)


def _learn(rows: DataFrame, width: int, sample: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Axes from the ``sample`` rows that come first by a hash of their ids, and
    the first CHECKED of these, ids and vectors."""
    first = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0), matrix(b.column(1), width)) for b in batches if b.num_rows]  # ``sample`` rows at most
        if parts:
            x = np.concatenate([v for _, v in parts])
            ids = pa.concat_arrays([i for i, _ in parts])[:CHECKED]
            yield pa.RecordBatch.from_arrays([pa.array([learn_axes(x).tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x[:CHECKED].tobytes()])], ["axes", "ids", "checked"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = first.coalesce(1).transform(map_arrow, run, f"axes binary, ids array<{kind}>, checked binary").first()
    return np.frombuffer(got.axes).reshape(width, -1), list(got.ids), np.frombuffer(got.checked).reshape(-1, width)


def _radius(rows: DataFrame, axes: np.ndarray, ids: list, checked: np.ndarray, k: int) -> int:
    """Within it are the codes of all but MISS of the checked rows' true k
    neighbours among all rows."""
    width = len(axes)
    code, size = encode(checked, axes), norms(checked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -2.0)
        apart = np.zeros((len(ids), k), dtype=np.int64)
        names = pa.array(ids)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = matrix(part.column(1), width)
                near = (checked / size[:, None]) @ (x / norms(x)[:, None]).T
                own = pa.compute.index_in(part.column(0), names.cast(part.column(0).type)).fill_null(-1).to_numpy()
                near[own[own >= 0], np.flatnonzero(own >= 0)] = -3.0
                codes = encode(x, axes)
                both = np.concatenate([best, near], axis=1)
                far = np.concatenate([apart, np.stack([distance(codes, c[None, :]) for c in code])], axis=1)
                # of equally near rows those with the farthest codes count: any of them may be an answer
                order = np.argpartition(-(np.round(both, 12) + far * 1e-14), k - 1, axis=1)[:, :k]
                best, apart = np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1)
        at = np.flatnonzero(best.ravel() > -2)
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(np.round(best.ravel()[at], 12)), pa.array(apart.ravel()[at])], ["q", "score", "apart"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("apart")))
    found = rows.transform(map_arrow, run, "q long, score double, apart long").withColumn("_rank", rank).filter(F.col("_rank") <= k).select("apart").collect()  # CHECKED * k rows at most
    return int(np.quantile([r.apart for r in found], 1 - MISS, method="higher")) if found else BITS


def coded(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """``rows`` (``_id, _v``) with ``_code``."""
    width = len(axes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                code = encode(matrix(part.column(1), width), axes)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(code)], [*part.schema.names, "_code"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.transform(map_arrow, run, f"{kinds}, _code binary")


def _binary(code: np.ndarray) -> pa.Array:
    offsets = np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(code.tobytes())])


def _codes(column: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bits // 8)


def _dealt(rows: DataFrame, index: Index, bits: int, probing: bool) -> DataFrame:
    """``rows`` with ``_p, _b``: the bucket of each position, or, probing, all
    buckets there that may hold what lies within the radius."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256 if probing else 8192):
                part = b.slice(i, 256 if probing else 8192)
                code = _codes(part.column(part.schema.get_field_index("_code")), bits)
                for p in range(index.m):
                    own = index.bucket(code, p)
                    reach = index.reach(p) if probing else np.zeros(1, np.int64)
                    bucket = (own[:, None] ^ reach[None, :]).ravel()
                    copies = part.take(pa.array(np.repeat(np.arange(len(code)), len(reach))))
                    yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(np.full(len(bucket), p, np.int32)), pa.array(bucket)], [*part.schema.names, "_p", "_b"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.transform(map_arrow, run, f"{kinds}, _p int, _b long")


def _within(table: DataFrame, queries: DataFrame, index: Index, bits: int, width: int, k: int, row_block: int, query_block: int) -> DataFrame:
    """``(_key, query_id, vec_id, score)``: for each query the k nearest of every
    block of rows within the radius."""
    rows, asked = _dealt(table, index, bits, False), _dealt(queries, index, bits, True)
    count = lambda df, name, block: df.groupBy("_p", "_b").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    # a row for each bucket: at most 16 * 2^PREFIX_BITS
    blocks = F.broadcast(count(_dealt(table.select("_code"), index, bits, False), "_rows", row_block).join(count(_dealt(queries.select("_code"), index, bits, True), "_asked", query_block), ["_p", "_b"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = rows.join(blocks, ["_p", "_b"]).withColumn("_r", F.pmod(F.xxhash64("_id", "_code"), "_rows")).withColumn("_q", every("_asked")).select("_p", "_b", "_r", "_q", "_id", "_code", "_v")
    asked = asked.join(blocks, ["_p", "_b"]).withColumn("_q", F.pmod(F.xxhash64("_key"), "_asked")).withColumn("_r", every("_rows")).select("_p", "_b", "_r", "_q", "_id", "_code", "_v", "_key")
    kind = table.schema["_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            p = key[0].as_py()
            codes, x = _codes(left.column("_code"), bits), matrix(left.column("_v").combine_chunks(), width)
            asked_codes, asked_x = _codes(right.column("_code"), bits), matrix(right.column("_v").combine_chunks(), width)
            size, asked_size = norms(x), norms(asked_x)
            ids = left.column("_id").combine_chunks()
            order_of, own = ids.to_numpy(zero_copy_only=False), pa.compute.index_in(ids, ids.unique()).to_numpy()
            asked_own = pa.compute.index_in(right.column("_id").combine_chunks(), ids.unique()).fill_null(-1).to_numpy()
            for i in range(len(asked_codes)):
                near = index.candidates(codes, asked_codes[i : i + 1], p)
                near = near[own[near] != asked_own[i]]
                cosine = (x[near] * asked_x[i]).sum(axis=1) / (size[near] * asked_size[i])
                order = np.lexsort((order_of[near], -cosine))[:k]
                out_q.append(np.full(len(order), i))
                out_v.append(near[order])
                out_s.append(cosine[order])
        at = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        to = pa.array(np.concatenate(out_v) if out_v else np.empty(0, np.int64))
        score = np.concatenate(out_s) if out_s else np.empty(0)
        asked_rows = right.select(["_key", "_id"]).take(pa.array(at))
        return pa.table({"_key": asked_rows.column(0), "query_id": asked_rows.column(1), "vec_id": left.column("_id").take(to), "score": pa.array(score)})

    ship_package(table.sparkSession)
    by = ["_p", "_b", "_r", "_q"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, f"_key long, query_id {kind}, vec_id {kind}, score double")


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, sample: int = SAMPLE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of queries its k
    nearest rows of vectors by cosine, without rows of the query's own id."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    valid = lambda df: df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(F.col("_id").isNotNull() & takes_part(F.col("_v")))
    width, n = _usual_width(valid(vectors))
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    rows = valid(vectors).filter(F.size("_v") == width)
    axes, ids, checked = _learn(rows, width, sample)
    bits = axes.shape[1]
    table = materialise(coded(rows, axes), "codes")
    left = materialise(coded(valid(queries).filter(F.size("_v") == width).withColumn("_key", F.monotonically_increasing_id()), axes), "queries")
    radius = _radius(table.select("_id", "_v"), axes, ids, checked, k) if n > k else bits
    best = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("score"), "vec_id"))
    parts = []
    while True:
        found = _within(table, left, Index.choose(radius, bits, n), bits, width, k, row_block, query_block)
        ranked = materialise(found.withColumn("rank", best).filter(F.col("rank") <= k), "neighbours")
        if radius >= bits:
            parts.append(ranked)
            break
        full = ranked.filter(F.col("rank") == k).select("_key")
        more = materialise(left.join(full, "_key", "left_anti").select(*left.columns), "short")
        parts.append(ranked.join(full, "_key", "left_semi"))
        discard(left)
        left = more
        if not left.take(1):
            break
        radius = min(2 * radius, bits)
    discard(table, left)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
