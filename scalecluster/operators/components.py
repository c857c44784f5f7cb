"""Connected components by alternating star contractions.

Large-star/small-star (Kiveris et al., SoCC 2014): every step is a grouped
minimum, partially aggregated, and an equi-join for which the edges of hubs
stay where they are, so a hub of millions of edges never meets in one task.
Paths of n nodes need O(log n) rounds.  Each step is written to the shared
folder, so a lost executor costs one step at most; a step's table is deleted
when the next one is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise, small_files
from ..session import ship_package
from .skew import join_counted

MAX_ROUNDS = 60


def _star(edges: DataFrame, by: list[str], large: bool, total: int) -> DataFrame:
    """One contraction of ``total`` edges; rows have u > v."""
    if large:  # every neighbour above u is linked to the least neighbour of u
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
        out = join_counted(both.filter("v > u"), least, [*by, "u"], 2 * total).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its lower neighbours are linked to the least of them
        least = edges.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        linked = join_counted(edges, least, [*by, "u"], total).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        out = linked.unionByName(least.select(*by, "u", F.col("m").alias("v"))).filter("u > v")
    return out.distinct()


def connected_components(edges: DataFrame, by: list[str] | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Components of undirected edges ``(u, v)``, per value of the ``by`` columns.

    Returns ``(*by, node, component)`` for every node of an edge between two
    different nodes; ``component`` is the least node reachable.  Nodes may be
    of any ordered type.  Rows with a null end and self-loops are ignored; no
    edges give an empty result.
    """
    by = by or []
    whole = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    current = materialise(edges.filter(whole).select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state() -> tuple:
        # xxhash64 sums identify the edge set; a fixed point is a forest of stars
        return tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(20,0)"))).first())

    now = state()
    for _ in range(max_rounds):
        before = now
        for large in (True, False):
            old, current = current, materialise(small_files(_star(current, by, large, now[0]), now[0]), "star")
            discard(old)
        now = state()
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(*by, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each a and b, in place, by hooking and pointer jumping;
    before and after ``root`` has the least index of each node's tree."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root[:] = root[root]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    root = np.arange(n)
    hook(root, a, b)
    return root


def grouped_components(edges: DataFrame, by: list[str], local_edges: int = 1_000_000) -> DataFrame:
    """As ``connected_components``.  If all edges are at most ``local_edges``,
    each group is solved in one task, all groups in parallel; else in rounds."""
    if edges.limit(local_edges + 1).count() > local_edges:
        return connected_components(edges, by)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        both = pa.chunked_array(table.column("u").chunks + table.column("v").chunks).combine_chunks()
        names = both.unique()
        names = names.take(pa.compute.sort_indices(names))
        place = pa.compute.index_in(both, names).to_numpy()
        root = local_roots(len(names), place[: table.num_rows], place[table.num_rows :])
        out = {n: pa.repeat(k, len(names)) for n, k in zip(by, key)}
        return pa.table(out | {"node": names, "component": names.take(pa.array(root))})

    ship_package(edges.sparkSession)
    whole = edges.filter("u is not null and v is not null and u <> v")
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in by), f"node {kinds['u']}", f"component {kinds['u']}"])
    return whole.groupBy(*by).applyInArrow(run, schema)
