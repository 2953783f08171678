"""Percentiles: exact ones, and sketches of bounded size in place of all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a sketch keeps before it starts to thin out.
KEPT = 8192


def percentiles(value: Column | str, ranks: list[float], kept: int = KEPT) -> Column:
    """An aggregate: for each rank the smallest value that at least that share of the values does not exceed.

    Groups of up to ``kept`` values are exact.  Larger ones are a KLL sketch of some ``3 * kept`` values,
    whatever their number, and what is returned has a rank within 0.05 % (at 8192) of the one asked for, with
    99 % confidence.  Sketches are made before the shuffle and merged after it.  Nulls do not count; null for
    a group without values."""
    value = F.col(value) if isinstance(value, str) else value
    sketch = F.kll_sketch_agg_double(value.cast("double"), F.lit(kept))
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks))))


#: How far from a rank, as a share of the values, the sketch's bounds lie: ten times its error.
BESIDE = 0.005


def exact_percentiles(rows: DataFrame, by: list[str], value: str, ranks: list[float]) -> DataFrame:
    """The columns ``by`` and ``percentiles``: for each rank the smallest value that at least that share of the
    group's values does not exceed, exactly.  Groups without values are left out; nulls do not count.

    A sketch gives two bounds about each rank.  Values below, between and above them are counted, which tells
    where the rank lies whatever the sketch's error, and only that part's values are looked at, each with its
    count: about one in a hundred.  Three scans; no group is ever in one place."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    around = sorted({min(1.0, max(0.0, r + d)) for r in ranks for d in (-BESIDE, BESIDE)})
    bounds = rows.groupBy(*by).agg(percentiles("_v", around).alias("_b"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    # a group's part is the number of bounds below a value
    parted = rows.alias("a").join(bounds.alias("b"), same("a", "b")).select(*[f"a.{c}" for c in by], "_v", F.size(F.filter("_b", lambda b: b < F.col("_v"))).alias("_part"))
    every = Window.partitionBy(*by)
    parts = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumns({"_all": F.sum("_n").over(every), "_to": F.sum("_n").over(every.orderBy("_part"))})
    # the place, from 1, of each rank's value, in the part that holds it
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1), F.ceil(F.lit(float(r)) * F.col("_all"))).alias("place")) for k, r in enumerate(ranks)])
    wanted = parts.select(*by, "_part", (F.col("_to") - F.col("_n")).alias("_before"), "_to", F.explode(places).alias("w")).where("w.place > _before AND w.place <= _to")
    asked = wanted.groupBy(*by, "_part", "_before").agg(F.collect_list("w").alias("_w"))
    within = parted.alias("a").join(asked.alias("b"), [*same("a", "b"), F.col("a._part") == F.col("b._part")]).groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a._part").alias("_part"), "_before", "_w", "_v").agg(F.count(F.lit(1)).alias("_n"))
    reached = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    found = within.withColumn("_to", reached).select(*by, "_v", (F.col("_to") - F.col("_n")).alias("_from"), "_to", F.explode("_w").alias("w")).where("w.place > _from AND w.place <= _to")
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("w.k", "_v"))), lambda x: x["_v"]).alias("percentiles"))


def with_percentiles(groups: DataFrame, rows: DataFrame, by: list[str], value: str, ranks: list[float]) -> DataFrame:
    """``groups`` (one row for each of ``by``) with :func:`exact_percentiles` of ``rows``; null without values."""
    p = exact_percentiles(rows, by, value, ranks)
    return groups.alias("g").join(p.alias("p"), [F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by], "left").select("g.*", "p.percentiles")
