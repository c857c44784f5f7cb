"""Multi-scale clustering: from items to one table of (scale, item_id, cluster).

All scales are computed in one plan.  Driver boundaries are one row of
statistics, which fixes the grid, and the check of the number of edges.  Written
tables stay until the driver ends; ``scratch.release`` deletes them earlier.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalise
from ..operators import blocks, minhash, sdcode, stats
from ..operators.components import grouped_components
from ..scratch import materialise
from .config import ClusterConfig


@dataclass
class SdCode:
    """A grid: item cells at the largest scale, the occupied ones of them, those
    of all scales, and the pairs of these that touch."""

    cells: DataFrame
    base: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    d: int
    largest: int
    scales: list[int]

    def labelled(self, labels: DataFrame) -> SdRun:
        """With the labels ``(scale, node, component)`` of the pairs' components."""
        labels = labels.withColumnRenamed("node", "code")
        named = self.nodes.join(labels, ["scale", "code"], "left").withColumn("cluster", F.coalesce("component", "code")).drop("component")
        return SdRun(self.cells, self.base, named, self.d, self.largest, self.scales)


@dataclass
class SdRun:
    """A grid clustering: as SdCode, nodes with their labels (the component's least code)."""

    cells: DataFrame
    base: DataFrame
    nodes: DataFrame
    d: int
    largest: int
    scales: list[int]

    def summary(self) -> DataFrame:
        """``(scale, cluster, codes, items)``."""
        return self.nodes.groupBy("scale", "cluster").agg(F.count(F.lit(1)).alias("codes"), F.sum("items").alias("items"))

    def items(self) -> DataFrame:
        """``(scale, item_id, cluster)``.  Labels of all scales are first joined
        to the occupied cells of the largest, so items are joined once."""
        names = [f"c{j}" for j in range(self.d)]
        own = [f"b{j}" for j in range(self.d)]
        base = self.base.select(*names, *[F.col(n).alias(b) for n, b in zip(names, own)])
        at = sdcode.at_scales(base, self.d, self.largest, self.scales, *own)
        labels = at.join(self.nodes.select("scale", *names, "cluster"), ["scale", *names])
        labels = labels.groupBy(*own).agg(F.collect_list(F.struct("scale", "cluster")).alias("_labels"))
        joined = self.cells.join(labels.withColumnsRenamed(dict(zip(own, names))), names)
        return joined.select("item_id", F.explode("_labels").alias("_l")).select("_l.scale", "item_id", "_l.cluster")


def resolve_model(config: ClusterConfig, d: int, n: int | None = None) -> str:
    """``auto``: SD below four dimensions; ``by_rows``: SD for more than 3^d rows, as
    far as a grid's neighbourhoods can be listed."""
    if config.model == "by_rows":
        return "SD" if n > 3**d and d <= config.max_sd_dimensions else "MIN"
    if config.model != "auto":
        return config.model
    return "SD" if d < 4 else "MIN"


def _scales(config: ClusterConfig, most: int) -> list[int]:
    end = stats.clamp_end_scale(config.end_scale, most)
    found = list(range(config.start_scale, end + 1))
    if not found:
        warnings.warn(f"no scale between {config.start_scale} and {end}: the result is empty", stacklevel=3)
    return found


def encode_sd(items: DataFrame, config: ClusterConfig, d: int, largest: int | None = None) -> SdCode | None:
    """items: ``item_id, vec``, and ``tokens`` if the largest scale is to follow
    from the numbers' text; without it their decimal text is taken.  Cells are
    computed at ``largest``, or else at the largest scale asked for."""
    if d > config.max_sd_dimensions:
        raise ValueError(f"{d} dimensions have {3**d} neighbours a cell; use MIN above {config.max_sd_dimensions}")
    whole = items if "tokens" in items.columns else items.withColumn("tokens", F.transform("vec", lambda x: x.cast("string")))
    if config.standardise:
        whole, items = normalise(whole), normalise(items.select("item_id", "vec"))
    if config.scales:
        found = stats.column_stats(items.select("item_id", "vec"), d).collect()
        scales = sorted(set(config.scales))
    else:
        found = stats.grid_stats(whole, d)
        if all(not r["diff"] for r in found):
            scales = _scales(config, max(config.end_scale, config.start_scale))  # one cell at any scale
        else:
            scales = _scales(config, stats.max_sd_scale(found, {r["dim"]: r["digits"] for r in found}))
    if not scales:
        return None
    largest = largest or max(scales)
    names = [f"c{j}" for j in range(d)]
    cells = sdcode.cell_columns(items.select("item_id", "vec"), found, largest, config.grid).select("item_id", *names)
    base = materialise(sdcode.occupied_base(cells, d), "base")
    nodes = sdcode.nodes_of(base, d, largest, scales)
    pairs = sdcode.neighbour_pairs(nodes, d, config.radius)
    if base.count() * len(scales) > config.local_edges:  # else they are found again in less time than a table takes
        nodes = materialise(nodes, "nodes")
        pairs = materialise(sdcode.neighbour_pairs(nodes, d, config.radius), "pairs")
    return SdCode(cells, base, nodes, pairs, d, largest, scales)


def run_sd(items: DataFrame, config: ClusterConfig, d: int, largest: int | None = None) -> SdRun | None:
    """``encode_sd`` and the components; None if no scale is in range."""
    code = encode_sd(items, config, d, largest)
    return code and code.labelled(grouped_components(code.pairs, ["scale"], config.local_edges))


def min_ladder(config: ClusterConfig, d: int) -> list[tuple[int, float]]:
    scales = sorted(set(config.scales)) if config.scales else _scales(config, stats.max_jaccard_scale(d, config.growth))
    return [(s, t) for s, t in stats.threshold_ladder(d, config.growth, 1, max(scales, default=0)) if s in scales]


def min_bits(items: DataFrame, config: ClusterConfig, d: int) -> DataFrame:
    """``(item_id, bits)``; one pass for the mid-ranges, one for the bits."""
    items = items.select("item_id", "vec")
    if config.standardise:
        items = normalise(items)
    mid = {r["dim"]: r["mid"] for r in stats.column_stats(items, d).collect()}
    return items.select("item_id", minhash.shingle_bits(F.col("vec"), [mid[j] for j in range(d)]).alias("bits"))


def encode_min(items: DataFrame, config: ClusterConfig, d: int, ladder: list[tuple[int, float]]) -> tuple[DataFrame, DataFrame]:
    """``(item_id, sig)`` and the edges ``(scale, u, v)``."""
    sigs = materialise(minhash.signatures(min_bits(items, config, d), d, config.hash_functions, config.seed), "signatures")
    pairs = minhash.candidates(minhash.bands(sigs, config.hash_functions, config.bands), config.hub_limit)
    scored = minhash.scored_pairs(pairs, sigs, config.hash_functions, min(t for _, t in ladder))
    return sigs, materialise(minhash.ladder_edges(scored, ladder), "edges")


def label_items(ids: DataFrame, found: DataFrame, scales: list[int], keep_unmatched: bool) -> DataFrame:
    """``(scale, item_id, cluster)`` from components ``(scale, node, component)``;
    an item without an edge is a cluster of its own, or left out."""
    found = found.select("scale", F.col("node").alias("item_id"), F.col("component").alias("cluster"))
    if not keep_unmatched:
        return found
    every = ids.select(F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"), "item_id")
    return every.join(found, ["scale", "item_id"], "left").withColumn("cluster", F.coalesce("cluster", "item_id"))


def _none(items: DataFrame, cluster: str | None = None) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    return items.sparkSession.createDataFrame([], f"scale int, item_id {kind}, cluster {cluster or kind}")


def run_min(items: DataFrame, config: ClusterConfig, d: int) -> DataFrame:
    """``(scale, item_id, cluster)`` by signatures; the label is the least item id."""
    ladder = min_ladder(config, d)
    if not ladder:
        return _none(items)
    sigs, edges = encode_min(items, config, d, ladder)
    return label_items(sigs, grouped_components(edges, ["scale"], config.local_edges), [s for s, _ in ladder], config.keep_unmatched)


#: Pairs in buckets for each item up to which ``run_highd`` and ``run_gaussian`` write pairs as
#: rows, which carry a signature of 4 bytes a function through a shuffle.
PAIRS_AN_ITEM = 4


def _weber_signatures(items: DataFrame, d: int, weber: float, d0: float, scales: list[int] | None, config: ClusterConfig) -> tuple[DataFrame, list[tuple[int, float]], bool]:
    """Signatures, the ladder from d0, and whether buckets have too many pairs for rows."""
    every = list(enumerate(stats.similarity_ladder(d, weber, d0)))
    ladder = [(s, t) for s, t in every if scales is None or s in scales]
    sigs = materialise(minhash.signatures(min_bits(items, config, d), d, config.hash_functions, config.seed), "signatures")
    dense = bool(ladder) and minhash.bucket_pairs(minhash.bands(sigs, config.hash_functions, config.bands)) > PAIRS_AN_ITEM * sigs.count()
    return sigs, ladder, dense


def _weber_pairs(sigs: DataFrame, ladder: list[tuple[int, float]], config: ClusterConfig) -> DataFrame:
    """Pairs scored without a hub limit."""
    pairs = minhash.candidates(minhash.bands(sigs, config.hash_functions, config.bands), None)
    return materialise(minhash.scored_pairs(pairs, sigs, config.hash_functions, min(t for _, t in ladder)), "scored")


def _codes(sigs: DataFrame, d: int, config: ClusterConfig) -> DataFrame:
    return materialise(blocks.coded(sigs, d, config.hash_functions, config.bands, config.seed), "codes")


#: Signatures of the runs below: 128 functions, as many bands as find pairs of a similarity of 0.4.
WEBER_CONFIG = ClusterConfig(model="MIN", hash_functions=128, bands=32, hub_limit=None)


def run_highd(items: DataFrame, d: int, weber: float = 1.0, d0: float = 0.0, scales: list[int] | None = None, config: ClusterConfig = WEBER_CONFIG) -> DataFrame:
    """``(scale, item_id, cluster)`` by signatures, all pairs of a band's bucket
    included; scale s = 0, 1, ... has the threshold (1 + weber)^s / d, at most 1."""
    sigs, ladder, dense = _weber_signatures(items, d, weber, d0, scales, config)
    if not ladder:
        return _none(items)
    if dense:
        edges = materialise(blocks.forest(_codes(sigs, d, config), d, config.hash_functions, config.bands, ladder), "edges")
    else:
        edges = minhash.ladder_edges(_weber_pairs(sigs, ladder, config), ladder)
    return label_items(sigs, grouped_components(edges, ["scale"], config.local_edges), [s for s, _ in ladder], config.keep_unmatched)


def run_gaussian(items: DataFrame, d: int, weber: float = 1.0, d0: float = 0.0, scales: list[int] | None = None, width: float = 0.1, config: ClusterConfig = WEBER_CONFIG) -> DataFrame:
    """As ``run_highd``, but of an item's neighbours at a scale only those stay
    that ``gaussian_prune`` keeps by the cosine of the vectors."""
    sigs, ladder, dense = _weber_signatures(items, d, weber, d0, scales, config)
    if not ladder:
        return _none(items)
    unit = normalise(items.select("item_id", "vec"))
    if dense:
        edges = materialise(blocks.pruned_forest(_codes(sigs, d, config), unit, d, config.hash_functions, config.bands, ladder, width), "edges")
    else:
        edges = _pruned_edges(_weber_pairs(sigs, ladder, config), unit, ladder, width)
    return label_items(sigs, grouped_components(edges, ["scale"], config.local_edges), [s for s, _ in ladder], config.keep_unmatched)


def _pruned_edges(scored: DataFrame, unit: DataFrame, ladder: list[tuple[int, float]], width: float) -> DataFrame:
    a, b = (unit.select(F.col("item_id").alias(n), F.col("vec").alias(f"_{n}")) for n in ("u", "v"))
    near = materialise(scored.join(a, "u").join(b, "v").select("u", "v", "sim", dot(F.col("_u"), F.col("_v")).alias("cos")), "cosines")
    steps = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(t).alias("least")) for s, t in ladder])
    near = near.select("u", "v", "cos", F.explode(F.filter(steps, lambda x: F.col("sim") >= x["least"])).alias("_s")).select("_s.scale", "u", "v", "cos")
    own = unit.select(F.explode(F.array(*[F.lit(s) for s, _ in ladder])).alias("scale"), F.col("item_id").alias("src"), F.col("item_id").alias("dst"), dot(F.col("vec"), F.col("vec")).alias("cos"))
    way = lambda src, dst: near.select("scale", F.col(src).alias("src"), F.col(dst).alias("dst"), "cos")
    kept = minhash.gaussian_prune(way("u", "v").unionByName(way("v", "u")).unionByName(own), width, ["scale"])
    return materialise(kept.filter("src <> dst").select("scale", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "edges")


def run_weber(items: DataFrame, d: int, weber: float = 1.0, span: float = 0.0, scales: list[int] | None = None, local_edges: int = 1_000_000) -> DataFrame:
    """``(scale, item_id, cluster)`` on one isotropic grid, scales from 0.

    The grid is as fine as the least distance of two values allows (floor of
    log2 of the range over it; ``span`` replaces the range if given).  With a
    growth of 1 scale s is the grid of s + 1 bits; else all scales use the
    finest grid and a neighbourhood of (1 + weber)^(bits - s) cells on each
    side, which must not exceed 20."""
    found = stats.column_stats(items, d).collect()
    least = stats.min_gap(items).agg(F.min("gap")).first()[0]
    if least is None:  # all values are equal
        return items.select(F.lit(0).alias("scale"), "item_id", F.lit(0).cast("long").alias("cluster"))
    most = span or max(r["max"] for r in found) - min(r["min"] for r in found)
    bits = max(1, int(math.log2(most / least)))
    every = range(stats.scale_count(weber, most, least))
    wanted = [s for s in (every if scales is None else scales) if s in every and (weber != 1 or s < bits)]
    if not wanted:
        return _none(items, "long")
    if weber == 1:
        config = ClusterConfig(scales=tuple(s + 1 for s in wanted), standardise=False, grid="isotropic", local_edges=local_edges)
        return run_sd(items, config, d, bits).items().withColumn("scale", F.col("scale") - 1)
    radii = {s: stats.neighbour_radius(weber, bits, s) for s in wanted}
    cells = sdcode.cell_columns(items.select("item_id", "vec"), found, bits, "isotropic")
    nodes = materialise(sdcode.occupied(cells, d, bits, [bits]), "nodes")
    parts = [sdcode.neighbour_pairs(nodes, d, n).withColumn("scale", F.lit(s)) for s, n in radii.items() if n]
    code = nodes.select("code", *[f"c{j}" for j in range(d)])
    labelled = code.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in wanted])))
    if parts:
        pairs = materialise(reduce(DataFrame.unionByName, parts), "pairs")
        labels = grouped_components(pairs, ["scale"], local_edges).withColumnRenamed("node", "code")
        labelled = labelled.join(labels, ["scale", "code"], "left").withColumn("cluster", F.coalesce("component", "code"))
    else:
        labelled = labelled.withColumn("cluster", F.col("code"))
    names = [f"c{j}" for j in range(d)]
    return cells.select("item_id", *names).join(labelled.select("scale", "cluster", *names), names).select("scale", "item_id", "cluster")


def cluster(items: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """``(scale, item_id, cluster)`` of items ``(item_id, vec array<double>[, tokens])``.

    No rows, or no scale in range, give an empty table."""
    config = config or ClusterConfig()
    d = stats.dimension_count(items)
    n = items.count() if d and config.model == "by_rows" else None
    if d and resolve_model(config, d, n) == "MIN":
        return run_min(items, config, d)
    run = run_sd(items, config, d) if d else None
    return run.items() if run else _none(items, "long")
