"""Joins and running totals that no single key or group can fill one task with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: No more keys than this are hot, whatever the data: a hot key has more than
#: one HOT_KEYS-th of all rows.  Their rows are broadcast (a few MB at most).
HOT_KEYS = 65_536
LEAST_HOT = 1024


def hot_bound(total: int) -> int:
    """Rows of a key beyond which it is hot."""
    return max(LEAST_HOT, total // HOT_KEYS)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "_n") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``keys``.

    ``count`` says how many rows a key has, or more, and ``total`` is the sum
    of all.  Rows of hot keys stay where they are, and their few keys go to
    them; the others are joined as usual, so a task gets at most ``hot_bound``
    rows of one key."""
    bound = hot_bound(total)
    cold = table.filter(F.col(count) <= bound).drop(count)
    if total <= bound:  # no key can be hot
        return rows.join(cold, keys)
    hot = F.broadcast(table.filter(F.col(count) > bound).drop(count))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def totals_before(groups: DataFrame, by: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``groups`` with ``name``: the sum of ``value`` over the rows of the same
    ``by`` with a smaller ``order`` (a number from 0, unique within ``by``).

    Blocks of ``block`` orders are summed first, so a task adds up one block,
    or the blocks' sums of one ``by``."""
    groups = groups.withColumn("_block", F.floor(F.col(order) / block))
    sums = groups.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_sum")
    sums = sums.select(*by, "_block", before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(order)) - F.col(value)
    return groups.withColumn(name, own).join(sums, [*by, "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")
