"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="evidentia-"))
        root = _OWN[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: for tables that cost much and are used more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
