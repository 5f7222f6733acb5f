"""Exact quantiles and ranks of long columns, without one task that sees a whole column.

Quantiles: a mergeable sketch gives an interval that holds the wanted ranks; the values in it
(a small share of all) are counted, and so are those below.  Ranks: the column is split
at sketched quantiles into ranges, and a range's ranks follow the number of values
in the ranges before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch, and the half width of the interval in its steps (its error is at most one).
ACCURACY, STEPS = 10_000, 10
#: Ranges in which a column is ranked.
RANGES = 128


def quantile(df: DataFrame, value: str | Column, q: float, by: list[str] | None = None, out: str = "quantile") -> DataFrame:
    """One row (of each group): the quantile ``q`` of the present values, between neighbours by linear interpolation.

    Missing values don't count; groups without any have no row, and a column without any gives one row with null.
    """
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    v = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    around = [max(0.0, q - STEPS / ACCURACY), min(1.0, q + STEPS / ACCURACY)]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, around)), ACCURACY)
    edges = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_e"))
    few = F.col("_n") < 2 * ACCURACY // STEPS  # then the interval could be shorter than a rank
    low = F.col("_least") if around[0] == 0 else F.when(few, F.col("_least")).otherwise(F.col("_e")[0])
    high = F.col("_most") if around[1] == 1 else F.when(few, F.col("_most")).otherwise(F.col("_e")[1])
    edges = edges.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    rows = v.join(F.broadcast(edges), keys) if by else v.crossJoin(F.broadcast(edges))  # a row for each group
    # All values below the interval are one row, those above aren't needed.
    rows = rows.where("_v <= _high").groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_to", upto).withColumn("_at", F.lit(float(q)) * (F.col("_n") - 1))
    first = lambda place: F.min(F.when(F.col("_to") > place, F.coalesce("_v", F.raise_error(F.lit("the sketch's interval doesn't hold the quantile")).cast("double"))))
    ends = rows.groupBy(*keys).agg(first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_b"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    return ends.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b")).alias(out))


def edges(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` ascending edges between ranges of about equally many values."""
    q = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    got = df.where(f"{value} is not null and not isnan({value})").agg(F.percentile_approx(value, q, ACCURACY).alias("e")).first().e
    return sorted({e for e in got or [] if e is not None and math.isfinite(e)})


def range_of(value: str | Column, bounds: list[float]) -> Column:
    """The number of edges that aren't over a value: nested comparisons, as many as the logarithm of the edges."""
    value = F.col(value) if isinstance(value, str) else value

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def ranked(df: DataFrame, value: str, ties: list[str], by: list[str] | None = None, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """``df`` with the rank (from 1) of each row's value, of equal ones by ``ties``, and the number of rows ``out + "_of"``, in
    each group of ``by``; groups are few, and the value isn't null."""
    by = by or []
    rows = df.withColumn("_range", range_of(value, edges(df, value, ranges)))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"))  # groups x ranges
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_c").over(Window.partitionBy(*by))
    counts = counts.select(*by, "_range", before.alias("_before"), total.alias(f"{out}_of"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value, *ties))
    return rows.join(F.broadcast(counts), [*by, "_range"]).withColumn(out, F.col("_before") + inside).drop("_range", "_before")
