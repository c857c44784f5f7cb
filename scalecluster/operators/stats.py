"""Statistics of the dimensions, and the ranges of scales that follow."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import decimals, no_nan
from ..session import map_arrow

#: Up to so many dimensions statistics are one row of aggregates, without a shuffle of components.
WIDE = 64


def dimension_count(items: DataFrame, vec: str = "vec") -> int:
    """The common length of all vectors; 0 for no rows, an error if they differ."""
    low, high = items.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low is None:
        return 0
    if low != high or low < 1:
        raise ValueError(f"vectors must have one length of at least 1, but have {low} to {high}")
    return high


def column_stats(items: DataFrame, d: int, vec: str = "vec") -> DataFrame:
    """``(dim, min, max, diff, mid)`` of each dimension, NaN and null left out."""
    if d <= WIDE:
        at = lambda j: no_nan(F.get(vec, F.lit(j)))
        both = [F.struct(F.lit(j).alias("dim"), F.min(at(j)).alias("min"), F.max(at(j)).alias("max")) for j in range(d)]
        rows = items.agg(F.array(*both).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    else:
        rows = items.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.min(no_nan(F.col("x"))).alias("min"), F.max(no_nan(F.col("x"))).alias("max"))
    diff = F.col("max") - F.col("min")
    return rows.select("dim", "min", "max", diff.alias("diff"), (F.col("min") + diff / 2).alias("mid"))


def precision(items: DataFrame, d: int, tokens: str = "tokens") -> DataFrame:
    """``(dim, digits)``: most digits after the point, of arrays of number texts."""
    digits = F.array(*[F.struct(F.lit(j).alias("dim"), F.max(decimals(F.get(tokens, F.lit(j)))).alias("digits")) for j in range(d)])
    return items.agg(digits.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def grid_stats(items: DataFrame, d: int, vec: str = "vec", tokens: str = "tokens") -> list[dict]:
    """``column_stats`` of ``vec`` and ``precision`` of ``tokens`` in one pass, as rows of (dim, min, max, diff, mid, digits)."""
    at = lambda j: no_nan(F.get(vec, F.lit(j)))
    each = [F.struct(F.lit(j).alias("dim"), F.min(at(j)).alias("min"), F.max(at(j)).alias("max"), F.max(decimals(F.get(tokens, F.lit(j)))).alias("digits")) for j in range(d)]
    rows = items.agg(F.array(*each).alias("s")).first().s
    found = [r.asDict() for r in rows]
    for r in found:
        r["diff"] = None if r["min"] is None else r["max"] - r["min"]
        r["mid"] = None if r["min"] is None else r["min"] + r["diff"] / 2
    return found


def max_sd_scale(stats: list, digits: dict[int, int]) -> int:
    """floor(log2(interval 10^digits)) - 1 for the least dimension; constant
    dimensions are left out.  0 if all are constant."""
    found = [math.floor(math.log2(r["diff"] * 10.0 ** digits.get(r["dim"], 0))) - 1 for r in stats if r["diff"]]
    return min(found, default=0)


def max_jaccard_scale(d: int, growth: float) -> int:
    return math.floor(math.log(d) / math.log1p(growth)) - 1


def clamp_end_scale(end: int, most: int) -> int:
    return most if end == 0 else min(end, most)


def threshold_ladder(d: int, growth: float, start: int, end: int) -> list[tuple[int, float]]:
    """(scale, least similarity) pairs, (1 + growth)^(scale - 1) / d, at most 1."""
    return [(s, min(1.0, (1 + growth) ** (s - 1) / d)) for s in range(start, end + 1)]


def min_gap(items: DataFrame, vec: str = "vec") -> DataFrame:
    """``(dim, gap)``: the least positive distance of two values; constant dimensions have none.

    Values are made distinct (partially aggregated) and sorted by ranges, so
    one dimension is spread over many tasks; each compares neighbours and passes
    on its first and last value of a dimension, which meet those of the next range."""
    kind = items.schema[vec].dataType.elementType.simpleString()
    values = items.select(F.posexplode(vec).alias("dim", "x")).filter(F.col("x").isNotNull() & ~F.isnan(F.col("x"))).distinct()
    ranged = values.repartitionByRange("dim", "x").sortWithinPartitions("dim", "x")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[float]] = {}  # first, last, least gap
        for b in batches:
            dim, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(dim, prepend=-1)), len(dim))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                before = seen.get(int(dim[i]))
                part = x[i:j] if before is None else np.append(before[1], x[i:j])
                gap = min(np.diff(part).min(initial=np.inf), np.inf if before is None else before[2])
                seen[int(dim[i])] = [part[0] if before is None else before[0], part[-1], gap]
        names = ["dim", "first", "last", "gap"]
        if seen:
            first, last, gap = zip(*seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array(v, b.schema.field(1).type) for v in (first, last)), pa.array([None if np.isinf(g) else g for g in gap], b.schema.field(1).type)], names)

    ends = ranged.transform(map_arrow, run, f"dim int, first {kind}, last {kind}, gap {kind}")
    step = F.col("first") - F.lag("last").over(Window.partitionBy("dim").orderBy("first"))  # a row for each range
    return ends.withColumn("gap", F.least("gap", step)).filter("gap > 0").groupBy("dim").agg(F.min("gap").alias("gap"))


def scale_count(weber: float, most: float, least: float) -> int:
    """Scales from least to most at a growth of weber a scale."""
    return int(math.log(most / least) / math.log1p(weber))


def similarity_ladder(d: int, weber: float, d0: float = 0.0) -> list[float]:
    """Thresholds (1 + weber)^s / d from s = 0, at most 1."""
    least = d0 if 0 < d0 < 1 else 1.0
    return [min(1.0, (1 + weber) ** s / d) for s in range(int(math.log(d / least) / math.log1p(weber)))]


def neighbour_radius(weber: float, bits: int, scale: int) -> int:
    """Cells looked at on each side at a scale whose growth isn't 2."""
    n = 1 if weber == 1 else int((1 + weber) ** (bits - scale))
    if n > 20:
        raise ValueError(f"a neighbourhood of {n} cells on each side is too large; use a larger scale")
    return n
