"""A clustering job from environment variables: ``python -m scalecluster.job``.

DATA_PATH (lines of numbers), OUTPUT_PATH, CODE_MODEL, LAMBDA, START_SCALE,
END_SCALE, DATA_STANDARDIZATION, NUMBER_OF_HASHTABLES, NUMBER_OF_BUCKETS,
SPARK_DEFAULT_PARALLELISM and STEP.  STEP 1 encodes and writes the edges, 2 finds
components, 3 writes the clusters and deletes what the steps left; without STEP
all are done.  Steps may be separate applications: they meet in OUTPUT_PATH/tmp.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .operators import stats
from .operators.components import grouped_components
from .plans import engine
from .plans.config import ClusterConfig
from .scratch import mark, release, remove
from .sources import io


def encode(spark: SparkSession, data: str, tmp: str, config: ClusterConfig) -> None:
    """Step 1: codes, edges, and a row of parameters for the others."""
    items = io.read_text(spark, data)
    d = stats.dimension_count(items)
    n = items.count() if d and config.model == "by_rows" else None
    model = engine.resolve_model(config, d, n) if d else "none"
    sidecar = {"model": model, "d": d, "largest": 0, "scales": [], "kind": "long"}
    if model == "SD":
        code = engine.encode_sd(items, config, d)
        if code:
            sidecar |= {"largest": code.largest, "scales": code.scales, "kind": code.nodes.schema["code"].dataType.simpleString()}
            for name in ("cells", "base", "nodes"):
                getattr(code, name).write.parquet(f"{tmp}/{name}")
            io.write_edges(code.pairs, f"{tmp}/edges")
    elif model == "MIN":
        ladder = engine.min_ladder(config, d)
        if ladder:
            sigs, edges = engine.encode_min(items, config, d, ladder)
            sidecar["scales"] = [s for s, _ in ladder]
            sigs.select("item_id").write.parquet(f"{tmp}/ids")
            io.write_edges(edges, f"{tmp}/edges")
    spark.createDataFrame([(json.dumps(sidecar),)], "value string").write.text(f"{tmp}/parameters")


def _parameters(spark: SparkSession, tmp: str) -> dict:
    return json.loads(spark.read.text(f"{tmp}/parameters").first().value)


def connect(spark: SparkSession, tmp: str, config: ClusterConfig) -> None:
    """Step 2: components of the edges."""
    known = _parameters(spark, tmp)
    if known["scales"]:
        edges = io.read_edges(spark, f"{tmp}/edges", known["kind"])
        io.write_components(grouped_components(edges.select("scale", "u", "v"), ["scale"], config.local_edges), f"{tmp}/components")


def decode(spark: SparkSession, tmp: str, output: str, config: ClusterConfig) -> None:
    """Step 3: clusters by scale, under OUTPUT_PATH/clusters."""
    known = _parameters(spark, tmp)
    if not known["scales"]:
        return
    labels = io.read_components(spark, f"{tmp}/components", known["kind"])
    if known["model"] == "SD":
        cells, base, nodes = (spark.read.parquet(f"{tmp}/{name}") for name in ("cells", "base", "nodes"))
        run = engine.SdCode(cells, base, nodes, nodes, known["d"], known["largest"], known["scales"]).labelled(labels)
        clusters: DataFrame = run.items()
    else:
        clusters = engine.label_items(spark.read.parquet(f"{tmp}/ids"), labels, known["scales"], config.keep_unmatched)
    io.write_clusters(clusters, f"{output}/clusters")


def run(spark: SparkSession, env: Mapping[str, str]) -> None:
    step = env.get("STEP", "").strip()
    if step not in ("", "1", "2", "3"):
        raise ValueError(f"STEP must be 1, 2, 3 or empty, not {step!r}")
    config = ClusterConfig.from_environment(dict(env))
    output = env["OUTPUT_PATH"].rstrip("/")
    tmp, since = f"{output}/tmp", mark()
    if "SPARK_DEFAULT_PARALLELISM" in env:
        spark.conf.set("spark.sql.shuffle.partitions", env["SPARK_DEFAULT_PARALLELISM"])
    if step in ("", "1"):
        encode(spark, env["DATA_PATH"], tmp, config)
    if step in ("", "2"):
        connect(spark, tmp, config)
    if step in ("", "3"):
        decode(spark, tmp, output, config)
        remove(spark, tmp)
    release(spark, since)


def main() -> None:
    env = os.environ
    builder = SparkSession.builder.appName(f"multi-scale clustering (lambda={env.get('LAMBDA', '')}) -> {env['OUTPUT_PATH'].rstrip('/').rsplit('/', 1)[-1]}")
    if "SPARK_DEFAULT_PARALLELISM" in env:
        builder = builder.config("spark.default.parallelism", env["SPARK_DEFAULT_PARALLELISM"])
    spark = builder.getOrCreate()
    run(spark, env)
    spark.stop()


if __name__ == "__main__":
    main()
