"""Grid codes: cells of each dimension, interleaved bit by bit.

Codes at the largest scale E determine those of all smaller ones: a cell at
scale s is the cell at E shifted right by E - s, and a code is a prefix.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a code that is a number; longer codes are text.
CODE_BITS = 62


def cell(x: Column, low: float | None, high: float | None, scale: int) -> Column:
    """The cell of x among 2^scale between low and high; NaN, null and
    constant dimensions are cell 0."""
    if low is None or high == low:
        return F.lit(0).cast("long")
    last = (1 << scale) - 1
    inner = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << scale))), F.lit(last))
    return F.when(x.isNull() | F.isnan(x) | (x == low), 0).when(x == high, last).otherwise(F.greatest(inner, F.lit(0))).cast("long")


def isotropic_cell(x: Column, low: float | None, gap: float, scale: int) -> Column:
    """The cell of x in a grid of one width for all dimensions, clipped to 2^scale cells."""
    if low is None or not gap:
        return F.lit(0).cast("long")
    inner = F.floor((x - F.lit(low)) / F.lit(gap))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit((1 << scale) - 1))).cast("long")


def cell_columns(items: DataFrame, stats: list, scale: int, grid: str = "per_dim", vec: str = "vec") -> DataFrame:
    """``items`` with a column c0, c1, ... for each dimension's cell at ``scale``."""
    widest = max((r["diff"] or 0.0 for r in stats), default=0.0) / (1 << scale)
    out = {}
    for r in sorted(stats, key=lambda r: r["dim"]):
        x = F.get(vec, F.lit(r["dim"]))
        out[f"c{r['dim']}"] = cell(x, r["min"], r["max"], scale) if grid == "per_dim" else isotropic_cell(x, r["min"], widest, scale)
    return items.withColumns(out)


def level_codes(items: DataFrame, stats: list, levels: int, vec: str = "vec") -> DataFrame:
    """``items`` with ``levels array<bigint>``: each component in steps of a
    ``levels``-th of its range, the maximum being ``levels``; NaN and constant
    dimensions are 0."""
    out = []
    for r in sorted(stats, key=lambda r: r["dim"]):
        x = F.get(vec, F.lit(r["dim"]))
        step = (r["diff"] or 0.0) / levels
        out.append(F.when(~F.isnan(x), F.floor((x - F.lit(r["min"])) / F.lit(step))).otherwise(0).cast("long") if step else F.lit(0).cast("long"))
    return items.withColumn("levels", F.array(*out))


def fits_number(d: int, scale: int) -> bool:
    return d * scale <= CODE_BITS


def code_number(cells: list[Column], scale: int) -> Column:
    """The interleaved bits as a number; the first dimension's bits lead."""
    d = len(cells)
    bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), i * d + d - 1 - j) for j, c in enumerate(cells) for i in range(scale)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def code_text(cells: list[Column], scale: int) -> Column:
    """The interleaved bits as a string of 0 and 1."""
    digits = [F.lpad(F.bin(c), scale, "0") for c in cells]
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(scale)), lambda i: F.concat(*[F.substr(x, i, F.lit(1)) for x in digits])), "")


def number_as_text(code: Column, bits: Column) -> Column:
    return F.lpad(F.bin(code), bits, "0")


def occupied_base(cells: DataFrame, d: int) -> DataFrame:
    """``(c0.., items)`` of the occupied cells at the largest scale."""
    return cells.groupBy(*[f"c{j}" for j in range(d)]).agg(F.count(F.lit(1)).alias("items"))


def at_scales(base: DataFrame, d: int, scale: int, scales: list[int], *more: str) -> DataFrame:
    """``(scale, c0.., *more)``: rows with cells at ``scale``, for all ``scales``."""
    rows = base.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    return rows.select("scale", *[F.expr(f"shiftright(c{j}, {scale} - scale)").alias(f"c{j}") for j in range(d)], *more)


def occupied(cells: DataFrame, d: int, scale: int, scales: list[int]) -> DataFrame:
    """``(scale, code, c0.., items)`` of the occupied cells at all ``scales``.

    Items are first counted by their cells at the largest scale, so what is
    repeated for the scales is the number of cells, not of items."""
    return nodes_of(occupied_base(cells, d), d, scale, scales)


def nodes_of(base: DataFrame, d: int, scale: int, scales: list[int]) -> DataFrame:
    names = [f"c{j}" for j in range(d)]
    nodes = at_scales(base, d, scale, scales, "items").groupBy("scale", *names).agg(F.sum("items").alias("items"))
    return nodes.withColumn("code", node_code(names, d, scale))


def node_code(names: list[str], d: int, scale: int) -> Column:
    """A cell's code from its columns; text where numbers are too short for it."""
    cells = [F.col(n) for n in names]
    if fits_number(d, scale):
        return code_number(cells, scale)
    width = F.col("scale")
    digits = [F.lpad(F.bin(c), width, "0") for c in cells]
    return F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(*[F.substr(x, i, F.lit(1)) for x in digits])), "")


def half_offsets(d: int, radius: int = 1) -> list[tuple[int, ...]]:
    """One of each pair of opposite offsets within ``radius``, without zero."""
    return [o for o in product(range(-radius, radius + 1), repeat=d) if o > (0,) * d]


def neighbour_pairs(nodes: DataFrame, d: int, radius: int = 1) -> DataFrame:
    """``(scale, u, v)``: pairs of codes of occupied cells that touch, each once.

    An equi-join on shifted cells: (3^d - 1) / 2 rows a cell at radius 1."""
    names = [f"c{j}" for j in range(d)]
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{j}") for j, x in enumerate(o)]) for o in half_offsets(d, radius)])
    left = nodes.select("scale", F.col("code").alias("u"), *names, F.explode(offsets).alias("o"))
    left = left.select("scale", "u", *[(F.col(n) + F.col(f"o.o{j}")).alias(n) for j, n in enumerate(names)])
    return left.join(nodes.select("scale", F.col("code").alias("v"), *names), ["scale", *names]).select("scale", "u", "v")
