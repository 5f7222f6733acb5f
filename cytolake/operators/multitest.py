"""Adjustment of p-values for many tests.

Adjusted values depend on a p-value's place among all.  Equal p-values are first
counted together, their table is split into ranges of p, and only the ranges' totals
(a few thousand rows at most) are summed in one task; so neither a single sort of all
rows nor a large group of ties is needed in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("none", "bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by")


def _range():
    """A number of a range of p that grows with p: finer near 0, where many are."""
    p = F.col("_p")
    return F.when(p >= 1e-3, 2000 + F.floor(p * 2000)).otherwise(F.greatest(F.lit(0), 1990 + F.floor(F.log2(F.greatest(p, F.lit(1e-300))) * 2))).cast("int")


def adjust(df: DataFrame, p: str, out: str = "padj", method: str = "fdr_bh", nulls_as_one: bool = False) -> DataFrame:
    """``df`` with adjusted p-values of the column ``p``; null stays null and isn't counted, unless ``nulls_as_one``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    value = F.when(~F.isnan(p), F.col(p))
    df = df.withColumn("_p", F.coalesce(value, F.lit(1.0)) if nulls_as_one else value)
    if method == "none":
        return df.withColumnRenamed("_p", out)
    counts = df.where("_p is not null").groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_range", _range())
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_rn"))
    before = F.coalesce(F.sum("_rn").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_rn").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select("_range", before.alias("_before"), total.cast("double").alias("_m"))  # a few thousand rows
    inside = Window.partitionBy("_range").orderBy("_p")
    ranked = counts.join(F.broadcast(ranges), "_range").withColumn("_to", F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    p_, m, upto, under = F.col("_p"), F.col("_m"), F.col("_to"), F.col("_to") - F.col("_n")
    harmonic = None
    if method in ("bonferroni", "sidak"):
        raw, direction = (p_ * m if method == "bonferroni" else -F.expm1(m * F.log1p(-F.least(p_, F.lit(1 - 1e-16))))), 0
    elif method == "holm":
        raw, direction = p_ * (m - under), 1
    elif method == "holm-sidak":
        raw, direction = -F.expm1((m - under) * F.log1p(-F.least(p_, F.lit(1 - 1e-16)))), 1
    elif method == "simes-hochberg":
        raw, direction = p_ * (m - upto + 1), -1
    else:
        raw, direction = p_ * m / upto, -1
        harmonic = method == "fdr_by"
    ranked = ranked.withColumn("_q", raw)
    if direction:
        edge = ranked.groupBy("_range").agg((F.max("_q") if direction > 0 else F.min("_q")).alias("_edge"))
        order = Window.orderBy(F.col("_range") if direction > 0 else F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select("_range", (F.max("_edge") if direction > 0 else F.min("_edge")).over(order).alias("_edge"))
        here = Window.partitionBy("_range").orderBy(F.col("_p") if direction > 0 else F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
        running = (F.max("_q") if direction > 0 else F.min("_q")).over(here)
        ranked = ranked.join(F.broadcast(edge), "_range").withColumn("_q", (F.greatest if direction > 0 else F.least)(running, F.coalesce("_edge", running)))
    if harmonic:
        euler = 0.57721566490153286
        sum_ = F.when(m <= 1e6, F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(1e6)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i)).otherwise(
            F.log(m) + euler + 1 / (2 * m) - 1 / (12 * m * m))
        factor = ranked.select("_m").limit(1).select(sum_.alias("_h"))
        ranked = ranked.crossJoin(F.broadcast(factor)).withColumn("_q", F.col("_q") * F.col("_h"))  # one row
    ranked = ranked.select("_p", F.least(F.col("_q"), F.lit(1.0)).alias(out))
    return df.join(ranked, "_p", "left").drop("_p")


def stouffer(df: DataFrame, p: str) -> DataFrame:
    """One row: the combined z and p-value of Stouffer's method over a column of p-values in [0, 1]."""
    from cytolake.functions.special import normal_isf, normal_sf

    z = df.select(normal_isf(p).alias("z"), F.assert_true((F.col(p) >= 0) & (F.col(p) <= 1), F.lit("p-values must be between 0 and 1")).alias("ok"))
    one = z.agg((F.sum("z") / F.sqrt(F.count("*"))).alias("z"), F.count("ok").alias("_"))
    return one.select("z", normal_sf("z").alias("pvalue"))
