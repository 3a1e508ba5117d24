"""Session defaults and stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when the plan above would have liked to keep its partitioning:
    # one extra exchange is cheaper than one task holding a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture on every Column call costs more than planning does for wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tracefold", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Runtime settings the results depend on, for a session somebody else built."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])


def local_session(cores: int | str = 8, app: str = "tracefold-local") -> SparkSession:
    """Session for tests and the local benchmark."""
    return build_session(
        app,
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.driver.memory": os.environ.get("TRACEFOLD_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared directory for stages.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) is a temporary folder used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    target = named or tempfile.mkdtemp(prefix="tracefold-checkpoint-")
    sc.setCheckpointDir(target)
    return target


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing is stored yet; any other fault is raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target) or not any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(target)):
        return None
    return spark.read.parquet(path)


_STAGES: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes in this block give up their shuffle files when they end: what was written is what will be read again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "stage", codec: str | None = None) -> DataFrame:
    """Write a state to a Parquet table in the shared folder and read it back.

    A lost executor then costs what came after the write, and later reads take only the columns they need. The folder
    stays until ``drop_stage`` or ``clear_stages``, since results are read lazily. ``codec`` packs it otherwise than usual.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path, compression=codec)
    _STAGES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracefold_stage = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_stage(df: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_tracefold_stage", None)
    if path is not None:
        _delete(df.sparkSession, path)
        if path in _STAGES:
            _STAGES.remove(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete every stage of this session, once its results are written."""
    while _STAGES:
        _delete(spark, _STAGES.pop())
