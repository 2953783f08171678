"""Percentiles of groups larger than a sketch holds exactly."""

from pyspark.sql import functions as F

from minuteworks.functions.quantiles import with_percentiles
from minuteworks.operators.logs import http_summary


def test_large_groups_are_exact(spark):
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, "a").alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % n).cast("double")).alias("v")).unionByName(spark.createDataFrame([("few", 5.0), ("few", 5.0), ("few", 7.0), ("none", None)], "g string, v double"))
    ranks = [0.0, 0.5, 0.95, 1.0]
    found = {r.g: r.percentiles for r in with_percentiles(rows.select("g").distinct(), rows, ["g"], "v", ranks).collect()}
    for group, keep in (("a", lambda i: i % 3 > 0), (None, lambda i: i % 3 == 0)):
        values = sorted(float(i * 7919 % n) for i in range(n) if keep(i) and i % 7 > 0)
        assert found[group] == [values[max(1, -(-int(r * 100) * len(values) // 100)) - 1] for r in ranks]
    assert found["few"] == [5.0, 5.0, 7.0, 7.0] and found["none"] is None


def test_http_summary_of_a_large_group(spark):
    n = 40_000
    lines = spark.range(n).select(F.lit("op").alias("operation"), F.lit("h").alias("host"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("failure"), (F.col("id") * 7919 % n).cast("double").alias("duration_ms"))
    row = http_summary(lines).first()
    assert (row.n_calls, row.p95_ms) == (n, n * 0.95 - 1)
