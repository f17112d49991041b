"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

#: Fits that run at the same time.
SIDE_BY_SIDE = 6


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    Taken from the session (``spark.checkpoint.dir`` or the directory already
    set on the context).  Only a local session that names none gets a temporary
    folder; on a cluster an unset folder is an error, because a machine-local
    path would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-gsx-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a table in the shared folder.

    Written as parquet, so later readers prune columns and know the size; a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of functions that each run Spark jobs of their own, in their order.

    An iterative fit of a few tasks leaves most cores idle, so fits run at the same time, as in
    Spark ML's cross validation.
    """
    with ThreadPool(max(1, min(len(jobs), SIDE_BY_SIDE))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], 1)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    Functions that run in tasks are found there by name.  The driver serves the archive, so
    nothing needs to be installed on the workers.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gsx_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-gsx-")) / "gsx.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._gsx_shipped = True
