"""Shared helpers: scratch tables in the folder the cluster shares, and table reading."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteworks.sources.scratch import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and a lost
    executor costs no recomputation of what stands before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose ``id_col`` is not in the one column of ``ids``; rows with a null id stay.
    The columns of ``docs`` may have any names."""
    gone = "_gone"
    while gone in docs.columns:
        gone += "_"
    ids = ids.toDF(gone)
    return docs.join(ids, docs[id_col] == ids[gone], "left_anti")


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows in what runs inside: texts and shingle sets are long, and each
    of an executor's workers holds a batch of them outside the heap.  The setting is the session's, as
    Spark has none for a query; rows come out the same with any size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
