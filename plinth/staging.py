"""Session defaults and the shared scratch area.

A frame that feeds several jobs is written once, as parquet, under the folder the
cluster names in ``spark.checkpoint.dir``.  Compared with ``persist`` this survives
lost executors without recomputation, and compared with ``checkpoint()`` it keeps
column pruning and gives Catalyst a true size to base its join choice on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_CHECKPOINT_KEY = "spark.checkpoint.dir"
# Shuffle files of a query otherwise stay until the driver's garbage collector meets the frame.
_FREE_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings a job of ours relies on; every one can be overridden by the submitter.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # HotSpot never compiles larger methods; text parsing fused into one stage can exceed it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "plinth", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for staged tables and ML checkpoints."""
    sc = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"set {_CHECKPOINT_KEY} to a folder shared by all executors before running on a cluster"
            )
        folder = tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set(_CHECKPOINT_KEY, folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark).rstrip('/')}/plinth-{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch area and return a scan of it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(df: DataFrame, label: str) -> DataFrame:
    """``stage``, and the shuffle files of the write are deleted as soon as it is done.

    That is a setting of the session meanwhile, so this is not for frames staged side by side.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES_KEY, None)
    conf.set(_FREE_SHUFFLES_KEY, "true")
    try:
        return stage(df, label)
    finally:
        if before is None:
            conf.unset(_FREE_SHUFFLES_KEY)
        else:
            conf.set(_FREE_SHUFFLES_KEY, before)


def at_once(calls: Sequence[Callable[[], T]], most: int = 8) -> list[T]:
    """Results of independent calls that run jobs, started together; the scheduler shares the cores among their jobs."""
    if not calls:
        return []
    with ThreadPoolExecutor(min(most, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(c)) for c in calls]]
