"""Stored intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_stored: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: stored tables go there")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="zonewright-")
    return _own_roots[app]


def discard(spark: SparkSession) -> None:
    """Remove the tables that this application has stored. For the end of a run: what reads them lazily can do so no more."""
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/zonewright/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a re-run of what came before, and row ids or
    partition numbers that were made on the way hold for every later reader.
    """
    path = scratch_path(df.sparkSession, label)
    _stored.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
