"""Connected components by contraction, all in joins and aggregates.

Each round points every node at its smallest neighbour, follows the pointers twice more, and replaces
both ends of every edge by where they point.  Edges inside what has merged vanish, so rounds get
smaller quickly; each is written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: the first two columns are node ids (long).  Returns ``id, component`` for every node
    that is not the smallest of its component; all others are their own."""
    a, b = edges.columns[:2]
    left = written(ordered(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges")
    labels = None
    while not left.isEmpty():
        step = written(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "pointers")
        for _ in range(2):
            step = follow(step, step, "to")
        step = written(step, "pointers")
        labels = step if labels is None else moved(labels, step)
        labels = written(labels, "labels")
        ends = follow(follow(left, step, "hi"), step, "lo")
        left = written(ordered(ends.select(F.col("hi").alias("x"), F.col("lo").alias("y"))), "edges")
    if labels is None:
        labels = left.select(F.col("hi").alias("node"), F.col("lo").alias("to"))
    return labels.select(F.col("node").alias("id"), F.col("to").alias("component"))


def ordered(edges: DataFrame) -> DataFrame:
    return edges.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def follow(df: DataFrame, step: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by where it points."""
    to = step.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def moved(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after a round: those that point on, and nodes that were the smallest until now."""
    old = follow(labels, step, "to")
    return old.unionByName(step.join(labels.select(F.col("node").alias("_old")), F.col("node") == F.col("_old"), "left_anti"))


def with_components(rows: DataFrame, id_col: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``: the label of ``id_col``, or itself."""
    found = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return rows.join(found, F.col(id_col) == F.col("_id"), "left").withColumn("component_id", F.coalesce("_component", id_col)).drop("_id", "_component")
