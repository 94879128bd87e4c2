"""Intermediate results in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; a folder of our own only where Spark is local."""
    global _local
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    if _local is None:
        _local = tempfile.TemporaryDirectory(prefix="linkcensus-")
    return _local.name


class Staging:
    """Writes a result once, for later jobs to read instead of computing it again.

    A written table outlives lost executors and cuts the lineage. On a cluster
    that names no shared folder results stay lazy, which costs time but changes
    nothing else.
    """

    def __init__(self, spark: SparkSession, enabled: bool = True):
        self._spark = spark
        self.folder = shared_folder(spark) if enabled else None

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        if self.folder is None:
            return df
        path = f"{self.folder}/linkcensus/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path).select(*df.columns)
