"""Tables in the folder that driver and executors share.

A written table cuts the lineage: what reads it survives the loss of any
executor.  Shuffle files of the job that wrote it are let go when it ends.
Tables that nothing deletes earlier are deleted when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch to delete a query's shuffle files at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_written: list[str] = []
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Only a local master may do without:
    on a cluster a folder of one machine would lose tables."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        known = context._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = context.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="scalecluster-")
        path = _local[app]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    target, system = _resolve(spark, path)
    system.deleteOnExit(target)
    _written.append(path)
    return path


@contextmanager
def _freeing(spark: SparkSession):
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def small_files(df: DataFrame, rows: int, task_rows: int = 50_000) -> DataFrame:
    """``df`` of about ``rows`` small rows in a task for each ``task_rows`` of them, 8 at
    least, so that a table isn't written as a file for each of many partitions."""
    return df.coalesce(max(8, rows // task_rows))


def mark() -> int:
    """A moment, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a moment, but those to keep."""
    kept = {df._scratch_path for df in keep}
    for path in _written[since:]:
        if path not in kept:
            remove(spark, path)
    _written[since:] = [p for p in _written[since:] if p in kept]


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    target, system = _resolve(spark, path)
    system.delete(target, True)


def _resolve(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first of base_, base__, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bucketed(df: DataFrame, label: str, column: str, grouped: bool = False) -> DataFrame:
    """``df`` written in buckets of ``column``: joins and groups on it then move
    the other side only.  Rows are shuffled once for that, unless a grouping by
    the column has done so."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = "scratch_" + path.rsplit("-", 1)[1]
    rows = df if grouped else df.repartition(n, column)
    with _freeing(spark):
        rows.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    out._scratch_path = path
    _tables[path] = name
    return out
