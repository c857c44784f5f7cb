"""Signatures of binarised vectors, banding, and scored pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import signature_tables
from ..session import map_arrow


def shingle_bits(vec: Column, mid: list[float | None]) -> Column:
    """1 where a component is at least the mid-range; NaN is 0."""
    mids = F.array(*[F.lit(m).cast("double") for m in mid])
    return F.zip_with(vec, mids, lambda x, m: F.when(~F.isnan(x) & (x >= m), 1).otherwise(0))


def shingles(bits: Column) -> Column:
    return F.transform(bits, lambda b, i: F.concat_ws("-", i, b))


def signatures(items: DataFrame, d: int, functions: int, seed: int = 100, id_col: str = "item_id", bits: str = "bits") -> DataFrame:
    """``(item_id, sig array<bigint>)``: each function's least value over the
    item's shingles.  A dimension has two shingles only, so both tables of hash
    values are constants, and a batch is d elementwise minima."""
    tables = signature_tables(d, functions, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                which = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                out = tables[0][which[:, 0]]
                for j in range(1, d):
                    np.minimum(out, tables[j][which[:, j]], out=out)
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * functions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["item_id", "sig"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item_id"), bits).transform(map_arrow, run, f"item_id {kind}, sig array<bigint>")


def bands(sigs: DataFrame, functions: int, n_bands: int) -> DataFrame:
    """``(band, key array<bigint>, item_id)``."""
    rows = functions // n_bands
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.slice("sig", i * rows + 1, rows))
    return sigs.select("item_id", F.posexplode(parts).alias("band", "key")).select("band", "key", "item_id")


def bucket_pairs(banded: DataFrame) -> int:
    """How many rows ``candidates`` without a limit compares, copies of a pair included."""
    sizes = banded.groupBy("band", F.xxhash64("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return int(sizes.agg(F.sum(F.expr("_n * (_n - 1) / 2"))).first()[0] or 0)


def candidates(banded: DataFrame, hub_limit: int | None = 5) -> DataFrame:
    """``(u, v)``, u < v: pairs that share a band's key, each once.  With a
    limit only a bucket's first items (by id) are paired with its members, so
    pairs grow with the bucket, not with its square."""
    if hub_limit is None:
        hubs = banded
    else:
        rank = F.row_number().over(Window.partitionBy("band", "key").orderBy("item_id"))
        hubs = banded.withColumn("_rank", rank).filter(F.col("_rank") <= hub_limit).drop("_rank")
    pairs = hubs.withColumnRenamed("item_id", "_hub").join(banded, ["band", "key"]).filter("_hub <> item_id")
    return pairs.select(F.least("_hub", "item_id").alias("u"), F.greatest("_hub", "item_id").alias("v")).distinct()


def packed(sigs: DataFrame) -> DataFrame:
    """``(item_id, sig binary)``: the values as 32-bit integers, which they fit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])], ["item_id", "sig"])

    kind = sigs.schema["item_id"].dataType.simpleString()
    return sigs.select("item_id", "sig").transform(map_arrow, run, f"item_id {kind}, sig binary")


def scored_pairs(pairs: DataFrame, sigs: DataFrame, functions: int, least: float = 0.0) -> DataFrame:
    """``(u, v, sim)``: the share of equal places of two signatures, each pair
    scored once for all scales; below ``least`` pairs are left out."""
    small = packed(sigs)
    a = small.select(F.col("item_id").alias("u"), F.col("sig").alias("_a"))
    b = small.select(F.col("item_id").alias("v"), F.col("sig").alias("_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                left, right = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<i4").reshape(-1, functions) for k in (2, 3))
                sim = (left == right).sum(axis=1) / functions
                keep = pa.array(np.flatnonzero(sim >= least))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(sim).take(keep)], ["u", "v", "sim"])

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.join(a, "u").join(b, "v").select("u", "v", "_a", "_b").transform(map_arrow, run, f"u {kind}, v {kind}, sim double")


def ladder_edges(scored: DataFrame, ladder: list[tuple[int, float]]) -> DataFrame:
    """``(scale, u, v)`` where a pair's similarity reaches the scale's threshold."""
    steps = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(t).alias("least")) for s, t in ladder])
    reached = F.filter(steps, lambda x: F.col("sim") >= x["least"])
    return scored.select(F.explode(reached).alias("s"), "u", "v").select("s.scale", "u", "v")


def gaussian_prune(pairs: DataFrame, width: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """``(*by, src, dst)`` kept of scored pairs ``(*by, src, dst, cos)``, those of an
    item with itself included: with s = e^((cos - 1) / width) and a source's sigma =
    sqrt(mean s), pairs with cos >= 1 - sigma stay, and the source's second most
    similar one in any case (ties by dst)."""
    by = by or []
    by_src = Window.partitionBy(*by, "src")
    sigma = F.sqrt(F.avg(F.exp((F.col("cos") - 1) / width)).over(by_src))
    rank = F.row_number().over(by_src.orderBy(F.desc("cos"), "dst"))
    return pairs.withColumn("_sigma", sigma).withColumn("_rank", rank).filter("cos - 1 >= -_sigma or _rank = 2").select(*by, "src", "dst")
