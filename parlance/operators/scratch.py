"""Tables between the steps of an iterative operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: in spark.checkpoint.dir, or for a local master that has
    none a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parlance-")
    return f"{base}/queries/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a workspace and read back: its lineage is cut, and a lost executor costs nothing."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
