"""Similar signatures where buckets are dense: pairs of blocks of items.

If a band's buckets hold a fixed share of all items, pairs as rows grow with
the square of the table.  Here items go to blocks, each pair of blocks to one
task, and a task compares its items' signatures, which are coded in a byte a
function.  A pair counts as it does elsewhere: it shares a band's key and its
similarity reaches a threshold.  No pair leaves a task: components need a
forest of each task only, and ``pruned_forest`` sums and the few nearest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import signature_tables
from ..functions.vectors import dot
from ..scratch import materialise
from ..session import map_arrow, ship_package
from .components import hook

#: Items of a block, and blocks at least.
BLOCK, LEAST_BLOCKS = 16_384, 8
#: Pairs looked at closely at a time.
CHUNK = 8192
#: Neighbours of an item that a task passes on.
NEAREST = 4


def coded(sigs: DataFrame, d: int, functions: int, n_bands: int, seed: int = 100) -> DataFrame:
    """``(item_id, code binary)``: of each function the rank of its value among
    the 2 d possible ones; the first functions of all bands lead, then the second ones."""
    tables = signature_tables(d, functions, seed)
    values = [np.unique(tables[:, :, f]) for f in range(functions)]
    order = np.arange(functions).reshape(n_bands, -1).T.ravel()
    kind = _code_type(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, functions)
            code = np.stack([np.searchsorted(values[f], sig[:, f]) for f in order], axis=1).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in code], pa.binary())], ["item_id", "code"])

    name = sigs.schema["item_id"].dataType.simpleString()
    return sigs.filter("item_id is not null").select("item_id", "sig").transform(map_arrow, run, f"item_id {name}, code binary")


def _code_type(d: int) -> str:
    return "u1" if 2 * d <= 256 else "<u2"


def _dealt(rows: DataFrame, total: int):
    """``rows`` grouped by pairs of blocks ``_i <= _j``; ``_left`` marks those of block ``_i``."""
    n = max(LEAST_BLOCKS, -(-total // BLOCK))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).withColumn("_left", F.col("_b") == F.col("_i")).drop("_b", "_o")
    return rows.repartition(n * (n + 1), "_i", "_j").groupBy("_i", "_j")  # twice as many tasks as pairs, so few have several


def _codes(table: pa.Table, d: int, functions: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), _code_type(d)).reshape(-1, functions)


def _near(codes: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``(a, b, n)`` of rows in ``left`` and in ``right`` with n >= ``least``
    equal places, a few at a time; ``once``: both are the same rows, each pair is given once."""
    a, b = (np.ascontiguousarray(codes[x].T) for x in (left, right))
    for i in range(0, len(left), 64):
        for j in range(i if once else 0, len(right), 4096):
            x, y = a[:, i : i + 64, None], b[:, None, j : j + 4096]
            n = np.zeros((x.shape[1], y.shape[2]), "u1" if len(a) < 256 else "u2")
            equal = np.empty(n.shape, bool)
            for f in range(len(a)):
                np.equal(x[f], y[f], out=equal)
                np.add(n, equal.view("u1"), out=n)
            p, q = np.nonzero(n >= least)
            if once:
                p, q = (z[q + j > p + i] for z in (p, q))
            for k in range(0, len(p), CHUNK):
                u, v = p[k : k + CHUNK], q[k : k + CHUNK]
                yield left[u + i], right[v + j], n[u, v]


def _share_band(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n_bands: int) -> np.ndarray:
    equal = (codes[a] == codes[b]).reshape(len(a), codes.shape[1] // n_bands, n_bands)
    return np.logical_and.reduce(equal, axis=1).any(axis=1)


def _needs(functions: int, ladder: list[tuple[int, float]]) -> list[tuple[int, int]]:
    """(scale, least number of equal places)."""
    share = np.arange(functions + 1) / functions
    return [(s, int(np.count_nonzero(share < t))) for s, t in ladder]


def _cosines(vecs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns of ``vecs``, summed from the first component to the last as ``dot`` does."""
    return np.add.reduce(vecs.take(a, axis=1) * vecs.take(b, axis=1), axis=0)


def _stars(ids: pa.Array, roots: dict[int, np.ndarray]) -> pa.Table:
    """``(scale, u, v)``: each node that isn't a root, with its root."""
    own = {s: np.flatnonzero(root != np.arange(len(root))) for s, root in roots.items()}
    parts = [pa.table({"scale": pa.array(np.full(len(at), s, np.int32)), "u": ids.take(pa.array(at)), "v": ids.take(pa.array(roots[s][at]))}) for s, at in own.items()]
    return pa.concat_tables(parts)


def _sides(key: tuple[pa.Scalar, ...], table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    left = table.column("_left").to_numpy()
    same = key[0].as_py() == key[1].as_py()
    return np.flatnonzero(left), np.flatnonzero(left if same else ~left), same


def forest(codes: DataFrame, d: int, functions: int, n_bands: int, ladder: list[tuple[int, float]]) -> DataFrame:
    """``(scale, u, v)``: edges with the same components as all pairs that share a
    band and reach the scale's similarity; at most one an item, scale and pair of blocks."""
    needs = _needs(functions, ladder)
    least = min(n for _, n in needs)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = _codes(table, d, functions)
        roots = {s: np.arange(len(at)) for s, _ in needs}
        for a, b, n in _near(at, *_sides(key, table)[:2], least, _sides(key, table)[2]):
            apart = np.zeros(len(a), bool)
            for s, need in needs:
                apart |= (n >= need) & (roots[s][a] != roots[s][b])
            a, b, n = a[apart], b[apart], n[apart]
            ok = _share_band(at, a, b, n_bands)
            for s, need in needs:
                hook(roots[s], a[ok & (n >= need)], b[ok & (n >= need)])
        return _stars(table.column("item_id").combine_chunks(), roots)

    ship_package(codes.sparkSession)
    kind = codes.schema["item_id"].dataType.simpleString()
    return _dealt(codes, codes.count()).applyInArrow(run, f"scale int, u {kind}, v {kind}")


class _Nearest:
    """The first ``NEAREST`` neighbours of each of some sources, by cosine, then id; NaN leads."""

    def __init__(self, size: int, rank: np.ndarray):
        self.rank, self.last, self.waiting = rank, np.full(size, -np.inf), 0
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, src: np.ndarray, dst: np.ndarray, cos: np.ndarray) -> None:
        cos = np.where(np.isnan(cos), np.inf, cos)
        keep = cos >= self.last[src]
        self.rows.append((src[keep], dst[keep], cos[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        src, dst, cos = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((self.rank[dst], -cos, src))
        src, dst, cos = src[order], dst[order], cos[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        self.last[src[place == NEAREST - 1]] = cos[place == NEAREST - 1]
        self.rows, self.waiting = [tuple(x[place < NEAREST] for x in (src, dst, cos))], 0
        return self.rows[0]


def _neighbourhoods(rows: DataFrame, total: int, d: int, functions: int, n_bands: int, needs: list[tuple[int, int]], width: float) -> DataFrame:
    """``(scale, src, n, total, best)`` of each source in each pair of blocks: its
    neighbours, the sum of their e^((cos - 1) / width), and the nearest of them."""
    kind = rows.schema["item_id"].dataType.simpleString()
    least = min(n for _, n in needs)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, ids = _codes(table, d, functions), table.column("item_id").combine_chunks()
        vecs = np.ascontiguousarray(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T)
        rank = np.empty(len(at), np.int64)
        rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(at))
        found = {s: (np.zeros(len(at), np.int64), np.zeros(len(at)), _Nearest(len(at), rank)) for s, _ in needs}
        left, right, same = _sides(key, table)
        for a, b, n in _near(at, left, right, least, same):
            ok = _share_band(at, a, b, n_bands)
            a, b, n = a[ok], b[ok], n[ok]
            cos = _cosines(vecs, a, b)
            weight = np.exp((cos - 1) / width)
            for s, need in needs:
                hit = n >= need
                count, sums, nearest = found[s]
                for src, dst in ((a[hit], b[hit]), (b[hit], a[hit])):
                    np.add.at(count, src, 1)
                    np.add.at(sums, src, weight[hit])
                    nearest.add(src, dst, cos[hit])
        parts = []
        for s, (count, sums, nearest) in found.items():
            src, dst, cos = nearest.settle()
            own, start = np.unique(src, return_index=True)
            best = pa.StructArray.from_arrays([pa.array(np.where(np.isinf(cos), np.nan, cos)), ids.take(pa.array(dst))], ["cos", "dst"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(src)).astype(np.int32)), best)
            parts.append(pa.table({"scale": pa.array(np.full(len(own), s, np.int32)), "src": ids.take(pa.array(own)), "n": pa.array(count[own]), "total": pa.array(sums[own]), "best": lists}))
        return pa.concat_tables(parts)

    return _dealt(rows, total).applyInArrow(run, f"scale int, src {kind}, n long, total double, best array<struct<cos: double, dst: {kind}>>")


def _wide_forest(rows: DataFrame, total: int, d: int, functions: int, n_bands: int, needs: list[tuple[int, int]]) -> DataFrame:
    """``(scale, u, v)``: a forest of the pairs that ``sigmas`` keep of an item, null if
    another way has found its pairs at a scale."""
    kind = rows.schema["item_id"].dataType.simpleString()
    least = min(n for _, n in needs)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = _codes(table, d, functions)
        vecs = np.ascontiguousarray(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T)
        flat = table.column("sigmas").combine_chunks().flatten()
        wide = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(needs))
        sigma = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, len(needs))
        roots = {s: np.arange(len(at)) for s, _ in needs}
        left, right, same = _sides(key, table)
        some = wide.any(axis=1)
        first, rest = left[some[left]], left[~some[left]]
        # each pair with a wide end once
        work = [(first, first, True), (first, rest, False)] if same else [(first, right, False), (rest, right[some[right]], False)]
        for x, y, once in work:
            for a, b, n in _near(at, x, y, least, once):
                apart = np.zeros(len(a), bool)
                for k, (s, need) in enumerate(needs):
                    apart |= (n >= need) & (wide[a, k] | wide[b, k]) & (roots[s][a] != roots[s][b])
                a, b, n = a[apart], b[apart], n[apart]
                ok = _share_band(at, a, b, n_bands)
                a, b, n = a[ok], b[ok], n[ok]
                cos = _cosines(vecs, a, b)
                for k, (s, need) in enumerate(needs):
                    keep = np.zeros(len(a), bool)
                    for end in (a, b):
                        keep |= wide[end, k] & ((cos - 1 >= -sigma[end, k]) | np.isnan(cos))
                    keep &= n >= need
                    hook(roots[s], a[keep], b[keep])
        return _stars(table.column("item_id").combine_chunks(), roots)

    return _dealt(rows, total).applyInArrow(run, f"scale int, u {kind}, v {kind}")


def pruned_forest(codes: DataFrame, unit: DataFrame, d: int, functions: int, n_bands: int, ladder: list[tuple[int, float]], width: float = 0.1) -> DataFrame:
    """``(scale, u, v)``: edges with the same components as the pairs that
    ``minhash.gaussian_prune`` keeps at each scale; ``unit``: ``(item_id, vec)`` of length one.

    Tasks sum up the neighbourhoods first, which gives each source's sigma, and
    pass on its few nearest.  A source for which more may be kept has its pairs
    looked at again, with its sigma known."""
    needs = _needs(functions, ladder)
    ship_package(codes.sparkSession)
    rows = materialise(codes.join(unit.select("item_id", "vec"), "item_id"), "coded")
    total = rows.count()
    parts = _neighbourhoods(rows, total, d, functions, n_bands, needs, width)
    most = F.when(F.col("n") > NEAREST, F.get("best", F.lit(NEAREST - 1))["cos"])
    own = rows.select(F.explode(F.array(*[F.lit(s) for s, _ in ladder])).alias("scale"), F.col("item_id").alias("src"), F.col("item_id").alias("dst"), dot(F.col("vec"), F.col("vec")).alias("cos"))
    own = own.select("scale", "src", F.lit(1).cast("long").alias("n"), F.exp((F.col("cos") - 1) / width).alias("total"), F.array(F.struct("cos", "dst")).alias("best"))
    every = parts.unionByName(own).withColumn("_most", most).groupBy("scale", "src")
    every = every.agg(F.sqrt(F.sum("total") / F.sum("n")).alias("_sigma"), F.max("_most").alias("_most"), F.flatten(F.collect_list("best")).alias("best"))
    place = lambda x: F.struct(F.when(F.isnan(x["cos"]), F.lit(float("-inf"))).otherwise(-x["cos"]).alias("key"), x["dst"].alias("dst"), x["cos"].alias("cos"))
    every = every.withColumn("best", F.sort_array(F.transform("best", place)))
    kept = F.filter("best", lambda x, i: ((x["cos"] - 1 >= -F.col("_sigma")) | (i == 1)) & (x["dst"] != F.col("src")))
    found = materialise(every.select("scale", "src", F.when(F.col("_most") - 1 >= -F.col("_sigma"), F.col("_sigma")).alias("sigma"), F.transform(kept, lambda x: x["dst"]).alias("kept")), "kept")
    edges = found.select("scale", F.col("src").alias("u"), F.explode("kept").alias("v"))
    wide = found.filter("sigma is not null")
    if wide.isEmpty():
        return edges
    sigmas = wide.groupBy(F.col("src").alias("item_id")).agg(F.array(*[F.max(F.when(F.col("scale") == s, F.col("sigma"))) for s, _ in ladder]).alias("sigmas"))
    again = rows.join(sigmas, "item_id", "left").withColumn("sigmas", F.coalesce("sigmas", F.array(*[F.lit(None).cast("double") for _ in ladder])))
    return edges.unionByName(_wide_forest(again, total, d, functions, n_bands, needs))
