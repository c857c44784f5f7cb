"""Reading of items and writing of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import parse_vector
from ..operators.skew import totals_before


def _numbered(lines: DataFrame) -> DataFrame:
    """``(item_id, value)``: lines by their place, from 0, files in order of their
    names.  Lines are counted by the blocks that files are read in; the running
    totals of these counts and a line's place in its block give its number."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = placed.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    files = totals_before(blocks.groupBy("_path").agg(F.sum("_n").alias("_n")).withColumn("_file", F.rank().over(Window.orderBy("_path")) - 1), [], "_file", "_n", "_files").select("_path", "_files")
    within = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start")) - F.col("_n")
    blocks = blocks.withColumn("_before", within).join(files, "_path").select("_path", "_start", (F.col("_before") + F.col("_files") - F.col("_first")).alias("_shift"))
    return placed.join(blocks, ["_path", "_start"]).select((F.col("_at") + F.col("_shift")).alias("item_id"), "value")


def read_text(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``(item_id, vec, tokens)`` of lines of numbers, separated by white space
    or commas.  item_id is the line's place, from 0; blank lines are left out
    after numbering."""
    lines = spark.read.text(path)
    lines = _numbered(lines) if ids else lines.withColumn("item_id", F.monotonically_increasing_id())
    tokens = F.filter(F.split("value", r"\s+|,"), lambda t: t != "")
    return lines.select("item_id", parse_vector(F.col("value")).alias("vec"), tokens.alias("tokens")).filter(F.size("vec") > 0)


def read_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(item_id, vec)`` from numeric columns."""
    return df.select(F.col(id_col).alias("item_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


def read_named_csv(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """``(item_id, name, vec)`` of a CSV with a header, a name and then numbers."""
    schema = "name string, " + ", ".join(f"x{j} double" for j in range(dimensions))
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    return rows.select(F.monotonically_increasing_id().alias("item_id"), "name", F.array(*[F.col(f"x{j}") for j in range(dimensions)]).alias("vec"))


def read_npy(spark: SparkSession, data: str, labels: str | None = None, slices: int = 64) -> DataFrame:
    """``(item_id, vec[, label])`` of a matrix file on the driver; for matrices
    that fit there, as the format has no partitions."""
    import numpy as np
    import pyarrow as pa

    matrix = np.load(data, mmap_mode="r")
    tags = np.load(labels) if labels else None
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    columns = {"item_id": pa.array(np.arange(len(matrix))), "vec": pa.ListArray.from_arrays(offsets, flat)}
    if tags is not None:
        columns["label"] = pa.array(tags)
    return spark.createDataFrame(pa.table(columns)).repartition(min(slices, max(1, len(matrix) // 1024)))


def write_clusters(clusters: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder for each scale, rows sorted by item.  Scales are split by
    ranges of items, so a scale isn't written by a single task."""
    ranged = clusters.repartitionByRange("scale", "item_id").sortWithinPartitions("scale", "item_id")
    ranged.write.partitionBy("scale").format(fmt).save(path)


def read_clusters(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return spark.read.schema("item_id long, cluster string, scale int").format(fmt).load(path)


def write_report(members: DataFrame, path: str) -> None:
    """Lines "scale<tab>cluster<tab>names", from evaluate.cluster_members; a
    cluster listed in parts has a line for each."""
    line = F.concat_ws("\t", F.col("scale").cast("string"), F.col("cluster").cast("string"), F.array_join("members", ", "))
    members.orderBy("scale", "cluster", "part").select(line.alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines "u,v", one folder for each scale."""
    edges.select("u", "v", "scale").write.partitionBy("scale").csv(path)


def read_edges(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(u, v, scale)``; a folder without files gives no rows."""
    return spark.read.schema(f"u {kind}, v {kind}, scale int").csv(path)


def write_components(components: DataFrame, path: str) -> None:
    """Lines "node,component" under the header "__id,component_id", one folder for each scale."""
    named = components.select(F.col("node").alias("__id"), F.col("component").alias("component_id"), "scale")
    named.write.partitionBy("scale").option("header", True).csv(path)


def read_components(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(scale, node, component)``."""
    rows = spark.read.schema(f"__id {kind}, component_id {kind}, scale int").option("header", True).csv(path)
    return rows.select("scale", F.col("__id").alias("node"), F.col("component_id").alias("component"))
