"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has bit b set if more than half of its shingles'
XXH64 values have it.  Two fingerprints within ``radius`` bits have a value
within radius / 2 of both, so every fingerprint stands for all values of that
ball (its variants), and fingerprints are dealt out by their variants: a task
owns the variants of one bit prefix and receives each fingerprint that has a
variant there.  It enumerates those variants, sorts them, and links every
fingerprint of a run to the run's least one, after verifying the distance.
Whatever shares a variant lies within ``radius`` by the triangle inequality, so
these stars lose no link.  Equal fingerprints are one row from the start, hence
copies cost nothing here, and one neighbourhood can't be larger than its ball.
Fingerprints and components with very many rows are joined where the rows are.

Defined cases: a null, empty or blank text has fingerprint 0 and is linked like
any other; fewer words than a shingle give one shingle of them all; every input
row has a row of the result, equal ids included; a null id stays null and never
names a component unless all of the component's ids are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components, local_roots
from ..operators.skew import join_counted
from ..scratch import discard, materialise, small_files
from ..session import map_arrow, ship_package
from .textkit import NOT_SPACE, Words, pieces, spans

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Variants that a bucket should have, and those that are sorted at a time (28 bytes each).
TASK_VARIANTS, SORTED_VARIANTS = 1 << 21, 1 << 20
#: Fingerprints that a bucket may have before it is dealt out further.
BUCKET_PRINTS = 1 << 20
#: Numbers of rows that are broadcast (8 MB); more are joined.
BROADCAST_IDS = 1_000_000
U64 = np.uint64


def batch_fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a batch of texts, as uint64."""
    from xxhash import xxh64_intdigest

    words = Words(column, NOT_SPACE, lower=True)
    out = np.zeros(words.rows, dtype=np.uint64)
    if not len(words):
        return out
    lengths = words.ends - words.starts + 1
    src = spans(words.starts, lengths)
    ends = np.cumsum(lengths)
    np.minimum(src, len(words.data) - 1, out=src)
    flat = words.data[src]
    flat[ends - 1] = 0x20
    starts, ends = ends - lengths, ends - 1
    counts = words.counts
    number = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = spans(words.first[:-1], number)
    last = first + np.minimum(np.repeat(counts, number), shingle) - 1
    raw = flat.tobytes()
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    filled = np.flatnonzero(number)
    at = np.concatenate([[0], np.cumsum(number[filled])])
    for i, row in enumerate(filled.tolist()) if len(filled) < 4 else ():
        out[row] = _majority(hashes[at[i] : at[i + 1]])
    if len(filled) >= 4:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, at[:-1], axis=0, dtype=np.int32)
        major = sums * 2 > number[filled][:, None]
        out[filled] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _majority(hashes: np.ndarray) -> np.uint64:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint long)``, one row for each input row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(batch_fingerprints(b.column(1), shingle).view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).transform(map_arrow, run, f"doc_id {kind}, fingerprint long")


def prefix_bits(n: int, radius: int) -> int:
    """Bits of the variants' prefix, so that a task holds about TASK_VARIANTS."""
    half = radius // 2
    ball = sum(comb(64, i) for i in range(half + 1))
    return int(np.clip(np.ceil(np.log2(max(1, n * ball / TASK_VARIANTS))), 4, 40))


def ball_masks(bits: int, reach: int) -> np.ndarray:
    """All masks of ``bits`` low bits with at most ``reach`` set."""
    out = [0]
    for k in range(1, reach + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), k)]
    return np.array(out, dtype=np.uint64)


def bucket_links(fps: np.ndarray, bucket: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, least member) among distinct fingerprints that meet
    in a variant whose ``bits`` highest bits are ``bucket``."""
    fps = np.sort(fps)
    half = radius // 2
    low = 64 - bits
    away = np.bitwise_count((fps >> U64(low)) ^ U64(bucket)).astype(np.int64)
    keep = away <= half
    fps, away = fps[keep], away[keep]
    moved = (fps & U64((1 << low) - 1)) | U64(bucket << low)  # the prefix flips are used up
    found: list[np.ndarray] = []
    index = np.arange(len(fps))

    def enumerate_variants(at: np.ndarray, value: np.ndarray, left: np.ndarray, free: int) -> None:
        """Runs of equal variants; splits on the next bit while there are too many."""
        sizes = np.array([len(ball_masks_cached(free, k)) for k in range(half + 1)])
        if len(at) < 2:
            return
        if sizes[left].sum() > SORTED_VARIANTS and free > 16:
            bit = U64(1) << U64(free - 1)
            for side in (U64(0), bit):
                here = (value & bit) == side
                ok = here | (left > 0)
                enumerate_variants(at[ok], (value[ok] & ~bit) | side, (left - ~here)[ok], free - 1)
            return
        variants = np.concatenate([(value[left == k][:, None] ^ ball_masks_cached(free, k)[None, :]).ravel() for k in range(half + 1)])
        owner = np.concatenate([np.repeat(at[left == k], sizes[k]) for k in range(half + 1)]).astype(np.int32)
        order = np.argsort(variants)
        variants = variants[order]
        new = np.empty(len(variants), dtype=bool)
        new[0] = True
        np.not_equal(variants[1:], variants[:-1], out=new[1:])
        if new.all():
            return
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(variants)))
        first, size = first[size > 1], size[size > 1]
        members = owner[order][spans(first, size)].astype(np.int64)
        hubs = np.repeat(np.minimum.reduceat(members, np.cumsum(size) - size), size)
        pairs = np.unique((members << 32 | hubs)[members != hubs])
        found.append(pairs)

    enumerate_variants(index, moved, half - away, low)
    if not found:
        return fps[:0], fps[:0]
    pairs = np.unique(np.concatenate(found))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    a, b = a[near], b[near]
    root = local_roots(len(fps), a, b)
    member = np.flatnonzero(root != np.arange(len(root)))
    return fps[member], fps[root[member]]


_masks: dict[tuple[int, int], np.ndarray] = {}


def ball_masks_cached(bits: int, reach: int) -> np.ndarray:
    if (bits, reach) not in _masks:
        _masks[bits, reach] = ball_masks(bits, reach)
    return _masks[bits, reach]


def _deal(rows: DataFrame, bits: int, more: int, half: int) -> DataFrame:
    """``(fingerprint, bucket)``: from buckets of ``bits`` bits (none: 0) to
    those of ``more`` bits beyond, as many copies as there are variants."""
    masks = F.array(*[F.lit(int(m)).cast("long") for m in ball_masks(more, half)])
    used = F.bit_count(F.shiftrightunsigned("fingerprint", 64 - bits).bitwiseXOR(F.col("bucket"))) if bits else F.lit(0)
    own = F.shiftrightunsigned("fingerprint", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
    dealt = rows.select("fingerprint", F.col("bucket") if bits else F.lit(0).cast("long").alias("bucket"), (F.lit(half) - used).alias("_left"), own.alias("_own"), F.explode(masks).alias("_mask"))
    dealt = dealt.filter(F.bit_count("_mask") <= F.col("_left"))
    return dealt.select("fingerprint", F.shiftleft("bucket", more).bitwiseOR(F.col("_own").bitwiseXOR(F.col("_mask"))).alias("bucket"))


def links(distinct: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fingerprint``)
    that join exactly those within ``radius`` bits into components.

    A bucket with more than BUCKET_PRINTS fingerprints is dealt out by 8 bits
    more, until none is left, so a task holds a bounded number."""
    if radius % 2:
        raise ValueError("the radius is halved, so it must be even")
    n = distinct.count() if n is None else n
    half, bits = radius // 2, prefix_bits(n, radius)
    ship_package(distinct.sparkSession)

    def linked(rows: DataFrame, bits: int) -> DataFrame:
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            fps = table.column("fingerprint").to_numpy().view(np.uint64)
            u, v = bucket_links(fps, key[0].as_py(), bits, radius)
            return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

        return rows.groupBy("bucket").applyInArrow(run, "u long, v long")

    left, parts = _deal(distinct.select("fingerprint"), 0, bits, half), []
    while n > BUCKET_PRINTS and bits <= 48:
        hot = materialise(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_PRINTS).select("bucket"), "hot-buckets")
        if not hot.take(1):
            break
        parts.append(linked(left.join(hot, "bucket", "left_anti"), bits))
        left = materialise(_deal(left.join(hot, "bucket"), bits, 8, half), "dealt")
        bits += 8
    out = linked(left, bits)
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


def _named(prints: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """``(fingerprint, root, component_id, _n)`` of the distinct fingerprints of
    ``(doc_id, fingerprint)``, where root is the component's least fingerprint
    and ``_n`` the number of rows, and the number of all rows."""
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("_n")), "distinct")
    size = distinct.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    edges = materialise(small_files(links(distinct.select("fingerprint"), radius, size.prints), size.prints), "links")
    found = connected_components(edges).select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    roots = materialise(small_files(distinct.join(found, "fingerprint", "left"), size.prints), "roots")
    linked = roots.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("_prints"))
    linked = join_counted(linked.select("fingerprint", "root", "_n"), least, ["root"], size.prints, "_prints")
    alone = roots.filter("root is null").select(F.col("fingerprint").alias("root"), "fingerprint", "_n", F.col("least_id").alias("component_id"))
    named = materialise(small_files(linked.unionByName(alone), size.prints), "named")
    discard(distinct, edges, roots)
    return named, size.rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint long, component_id)``: component_id is the least
    id whose fingerprint is reachable by links of at most ``radius`` bits."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named, total = _named(prints, radius)
    return join_counted(prints, named, ["fingerprint"], total).select("doc_id", "fingerprint", "component_id")


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(_place, doc_id, fingerprint, _row)``: whole rows, numbered, with their fingerprints."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            prints = pa.array(batch_fingerprints(b.column(3), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints, b.column(2)], ["_place", "doc_id", "fingerprint", "_row"])

    rows = docs.select(F.monotonically_increasing_id().alias("_place"), F.col(id_col).alias("doc_id"), F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    fields = rows.schema.fields
    return rows.transform(map_arrow, run, T.StructType([*fields[:2], T.StructField("fingerprint", T.LongType()), fields[2]]))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group: that of the least id, null ids last,
    and the first of its rows if there are more.

    Rows are written once with their fingerprints and a number, by which one
    rule holds for null, equal and unique ids.  Whichever are fewer, the numbers
    to keep or to drop, are broadcast if they are at most BROADCAST_IDS; else
    rows are joined with them.  Columns may have any names."""
    marked = materialise(_marked(docs, id_col, text_col, shingle), "marked")
    prints = marked.select("_place", "doc_id", "fingerprint")
    named, total = _named(prints, radius)
    groups = join_counted(prints, named, ["fingerprint"], total)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_place")).alias("_first"))
    kept = materialise(small_files(first.select(F.col("_first._place").alias("_place")), total), "kept")
    n = kept.count()
    if n <= min(total - n, BROADCAST_IDS):
        out = marked.join(F.broadcast(kept), "_place", "left_semi")
    elif total - n <= BROADCAST_IDS:
        out = marked.join(F.broadcast(materialise(prints.select("_place").join(kept, "_place", "left_anti"), "dropped")), "_place", "left_anti")
    else:
        out = marked.join(kept, "_place", "left_semi")
    discard(named)
    return out.select("_row.*")
