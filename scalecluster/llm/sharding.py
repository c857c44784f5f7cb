"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash bits are md5 bits of its key; the directory starts with one
bucket, and only a bucket over the byte limit splits on its next bit, until
every shard fits.  Instead of splitting one bit at a time, a pass sums bytes
by a prefix some bits deeper than needed (partially aggregated, so rows aren't
shuffled for it), rolls the sums up to every shorter prefix, and takes for each
cell the shortest prefix that fits: that is where splitting would have stopped.
Cells that still are too large, for instance a key that a third of the rows
share, go on alone; after the key's bits follow bits of the row's content and
place, so equal keys and even equal rows can be split.

Defined cases: a null text has 0 bytes; a null key is hashed as the empty
string; a single row over the limit is a shard of its own (``oversize``); an
empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import free_name, materialise

SHARD_BYTES = 1 << 20
#: Bits looked ahead in a pass, beyond those that an even spread would need.
SPARE_BITS = 2
KEY_BITS = 60
ROW_BITS = 60


def _bits(text) -> Column:
    """The first 60 bits of the text's md5, as a string of 0 and 1."""
    return F.lpad(F.bin(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), 60, "0")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, shard_id, local_depth, oversize)``, one row for each
    input row; shard_id is the bit prefix (empty: the only shard)."""
    return _assigned(docs, id_col, text_col, limit, [F.col(id_col).alias("doc_id")])


def _assigned(docs: DataFrame, id_col: str, text_col: str, limit: int, carried: list[Column]) -> DataFrame:
    """The ``carried`` columns of all rows, and what ``assign`` adds."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    place = F.concat_ws("/", key, F.xxhash64(text_col).cast("string"), F.monotonically_increasing_id().cast("string"))
    rows = docs.select(*carried, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.concat(_bits(key), _bits(place)).alias("bits"))
    names = rows.columns[:-1]
    rows = materialise(rows, "shard-rows")
    left, depth, parts = rows, 0, []
    while depth < KEY_BITS + ROW_BITS:
        top = left.agg(F.sum("n_bytes").alias("b")).first().b or 0
        more = max(1, math.ceil(math.log2(max(1.0, top / limit)))) + SPARE_BITS
        deeper = min(depth + min(more, 24), KEY_BITS + ROW_BITS)
        cell = F.substring("bits", 1, deeper)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        fit = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("pb"), F.sum("n").alias("pn")).filter((F.col("pb") <= limit) | (F.col("pn") == 1))
        found = levels.join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", (F.col("pb") > limit).alias("oversize")), "depth").alias("leaf"))
        directory = materialise(cells.join(found, "cell", "left").select("cell", "leaf"), "shard-cells")
        keyed = left.withColumn("cell", cell)
        done = keyed.join(directory.filter("leaf is not null"), "cell")
        parts.append(done.select(*names, F.expr("substring(bits, 1, leaf.depth)").alias("shard_id"), F.col("leaf.depth").alias("local_depth"), F.col("leaf.oversize").alias("oversize")))
        hot = directory.filter("leaf is null")
        if not hot.take(1):
            break
        left = materialise(keyed.join(hot, "cell", "left_semi").drop("cell"), "shard-hot")
        depth = deeper
    else:
        parts.append(left.select(*names, F.col("bits").alias("shard_id"), F.lit(depth).alias("local_depth"), F.lit(True).alias("oversize")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, by: str = "shard") -> None:
    """Writes ``docs`` as Parquet, one folder ``<by>=p<prefix>`` for each shard.

    Every row goes to the shard that ``assign`` found for itself, equal ids
    included, so a shard keeps to the limit.  ``by`` must not name a column."""
    if free_name(docs, by) != by:
        raise ValueError(f"the table has a column {by!r}; name the folders otherwise")
    shards = _assigned(docs, id_col, text_col, limit, [F.struct("*").alias("_row")])
    shards.select("_row.*", F.concat(F.lit("p"), "shard_id").alias(by)).repartition(by).write.partitionBy(by).parquet(path)
