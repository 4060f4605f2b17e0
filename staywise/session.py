"""Session settings the package is tuned for."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture per column expression: it dominates the planning of wide plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def session(app: str = "staywise", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the package's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write a small intermediate result that several passes read, and cut its lineage.

    The folder is the one the session names in ``spark.checkpoint.dir``, which
    all executors share. Where it is unset, a local master gets a folder of its
    own and a cluster recomputes instead.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.master.startswith("local"):
        folder = _local_folder()
    if context.getCheckpointDir() is None:
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``; a local one where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local_folder()
    return f"{top}/work-{uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="run-")
