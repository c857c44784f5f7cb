"""Encoding of a stream of items against statistics fixed beforehand.

Cells depend on an item and the grid only, so a stream is encoded without
state; labels come from the nodes of a finished run, joined as a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalise
from ..operators.sdcode import cell_columns
from ..plans.engine import SdRun


def encode_stream(items: DataFrame, stats: list, scale: int, standardise: bool = True, grid: str = "per_dim") -> DataFrame:
    """``(item_id, c0, ...)`` for a streaming table ``(item_id, vec)``."""
    items = items.select("item_id", "vec")
    cells = cell_columns(normalise(items) if standardise else items, stats, scale, grid)
    return cells.select("item_id", *[f"c{j}" for j in range(len(stats))])


def label_stream(cells: DataFrame, run: SdRun) -> DataFrame:
    """``(scale, item_id, cluster)``; items in cells that the run hasn't seen get null."""
    names = [f"c{j}" for j in range(run.d)]
    at = cells.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in run.scales])))
    at = at.select("item_id", "scale", *[F.expr(f"shiftright({n}, {run.largest} - scale)").alias(n) for n in names])
    return at.join(run.nodes.select("scale", *names, "cluster"), ["scale", *names], "left").select("scale", "item_id", "cluster")
