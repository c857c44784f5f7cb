"""Summaries of clusters, and how well they match known labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("scale", "cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_members(clusters: DataFrame, names: DataFrame, id_col: str = "item_id", name_col: str = "name", chunk: int = 100_000) -> DataFrame:
    """``(scale, cluster, part, members)``: the names of each cluster's items, sorted.

    A cluster of more than ``chunk`` items is listed in parts of about that
    many, so a list has a bound.  Parts are ranges of names: in the order of
    ``part``, whose numbers may have gaps, they make up the sorted list."""
    named = clusters.join(names.select(F.col(id_col).alias("item_id"), F.col(name_col).alias("_name")), "item_id").select("scale", "cluster", "_name")
    if clusters.limit(chunk + 1).count() <= chunk:  # no cluster can be larger
        named = named.withColumn("part", F.lit(0).cast("long"))
    else:
        named = materialise(named, "named")
        sizes = materialise(cluster_sizes(named).filter(F.col("size") > chunk), "sizes")  # fewer than one in ``chunk`` rows
        large, keys = F.broadcast(sizes.select("scale", "cluster")), ["scale", "cluster"]
        parts = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // chunk))
        ranged = named.join(large, keys, "left_semi").repartitionByRange(parts, *keys, "_name").withColumn("part", F.spark_partition_id().cast("long"))
        named = ranged.unionByName(named.join(large, keys, "left_anti").withColumn("part", F.lit(0).cast("long")))
    return named.groupBy("scale", "cluster", "part").agg(F.sort_array(F.collect_list("_name")).alias("members"))


def cluster_texts(members: DataFrame, separator: str = ",") -> DataFrame:
    """``(scale, cluster, members)``: one text for each cluster, its parts of
    ``cluster_members`` put together again; null without a name.  A text is
    a row, so a cluster's names must fit the 2 GB that a row may have."""
    text = F.when(F.size("members") > 0, F.array_join("members", separator))
    parts = members.select("scale", "cluster", "part", text.alias("_text")).groupBy("scale", "cluster")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "_text"))), lambda x: x["_text"])
    return parts.agg(F.when(F.count("_text") > 0, F.array_join(ordered, separator)).alias("members"))


def cluster_tags(clusters: DataFrame, labels: DataFrame, least_size: int = 3) -> DataFrame:
    """``(scale, cluster, size, label, n)``: how often each label occurs in the
    clusters of at least ``least_size`` items.  ``labels`` has item_id and label."""
    counts = clusters.join(labels, "item_id").groupBy("scale", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("scale", "cluster").agg(F.sum("n").alias("size")).filter(F.col("size") >= least_size)
    return counts.join(sizes, ["scale", "cluster"]).select("scale", "cluster", "size", "label", "n")


def majority(clusters: DataFrame, labels: DataFrame, least_size: int = 2) -> DataFrame:
    """``(scale, cluster, label, n, size)``: the most frequent label of each
    cluster of at least ``least_size`` items; ties go to the smaller label.
    ``labels`` has item_id and label."""
    counts = clusters.join(labels, "item_id").groupBy("scale", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    # both come from counts by label, whose number is small
    both = counts.groupBy("scale", "cluster").agg(F.sum("n").alias("size"), F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("top"))
    return both.filter(F.col("size") >= least_size).select("scale", "cluster", "top.label", "top.n", "size")


def best_f1(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, class_size, f1, precision, recall, cluster_size, scale, cluster)``:
    for each label the cluster with that majority whose F1 is largest, over all
    scales; ties go to the smaller scale and cluster.  0 where there is none."""
    classes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    rated = majority(clusters, labels).join(classes, "label")
    rated = rated.withColumn("precision", F.col("n") / F.col("size")).withColumn("recall", F.col("n") / F.col("class_size"))
    rated = rated.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    # a grouped minimum, partially aggregated: labels are few and clusters many
    order = F.struct((-F.col("f1")).alias("_less"), "scale", "cluster", "f1", "precision", "recall", F.col("size").alias("cluster_size"))
    best = rated.groupBy("label").agg(F.min(order).alias("_best")).select("label", *[f"_best.{n}" for n in ("f1", "precision", "recall", "cluster_size", "scale", "cluster")])
    return classes.join(best, "label", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
