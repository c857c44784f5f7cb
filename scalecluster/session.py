"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of long texts would fill Arrow batches of the default size (64 MB) on
#: both sides of each worker; unless the session has a size of its own, this one holds.
BATCH_BYTES_KEY, BATCH_BYTES_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application: Python workers
    import what a task's function refers to."""
    if spark.conf.get(BATCH_BYTES_KEY, BATCH_BYTES) == BATCH_BYTES_DEFAULT:
        spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="scalecluster-")) / "scalecluster.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("scalecluster") / f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
