"""Time zones as data: a table of the names that the engine knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "_zone"
#: Names that conversions take but the list leaves out.
ALSO = ("EST", "MST", "HST")


def zone_names(spark: SparkSession) -> DataFrame:
    """``name, folded``: some six hundred zone names, and each in lower case."""
    listed = F.expr("java_method('java.time.ZoneId', 'getAvailableZoneIds')")
    names = spark.range(1).select(F.explode(F.concat(F.split(F.regexp_replace(listed, r"[\[\]\s]", ""), ","), F.array(*map(F.lit, ALSO)))).alias("name"))
    return names.where(~F.col("name").startswith("SystemV/")).distinct().select("name", F.lower("name").alias("folded"))


def with_zone(df: DataFrame, zone: Column) -> tuple[DataFrame, Column]:
    """``df`` with a column for the engine's name of ``zone``, null if it is unknown, and that column.  Case
    does not matter.  The table is fixed and small, so it is broadcast; an unknown zone is a row without a
    match, never an error."""
    names = zone_names(df.sparkSession).groupBy("folded").agg(F.min("name").alias(ZONE))
    return df.join(F.broadcast(names), F.lower(zone) == F.col("folded"), "left").drop("folded"), F.col(ZONE)
