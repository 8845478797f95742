"""Session construction and the shared folder for materialised results."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    On a cluster leave ``spark.sql.shuffle.partitions`` high and let adaptive
    execution coalesce; broadcast sizes stay under Spark's own threshold check.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_stages: list[list[str]] = []  # per open scope, the paths handed out in it


def delete_stage(spark: SparkSession, path: str) -> bool:
    """Delete a folder under the shared folder; anything else is refused."""
    jvm = spark.sparkContext._jvm
    target, root = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    if not target.toUri().getPath().startswith(root.toUri().getPath().rstrip("/") + "/"):
        raise ValueError(f"{path} is not under the shared folder")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stages(spark: SparkSession):
    """Delete the stages written inside the block when it ends; use their results before."""
    _stages.append([])
    try:
        yield
    finally:
        for path in _stages.pop():
            delete_stage(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted with the innermost ``stages`` block around the call."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _stages:
        _stages[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, cut its lineage there and read it back.

    Parquet keeps the copy compact and column-prunable, and its known size lets
    Spark decide on broadcasts from facts. Losing an executor loses nothing.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
