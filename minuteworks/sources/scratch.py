"""The folder that driver and executors share for scratch tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only where that is unset (tests on one machine) is a
    local folder made, one for each Spark context."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_minuteworks_shared", None)
    if not path and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = context._minuteworks_shared = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is read more than once is made once, and a lost executor
    costs nothing of what stands before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
