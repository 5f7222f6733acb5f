"""Differentially methylated regions: clusters of significant sites along chromosomes.

Clustering is a gap rule over sorted positions.  So that a chromosome isn't one task,
positions are first split into tiles; a tile's first site looks at the last site of the
tile before, which a table with one row per tile gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.expressions import clean_chromosome
from cytolake.operators.ranks import quantile

#: Positions in a tile.
TILE = 1 << 22


def _before_tile(edges: DataFrame, keys: list[str], order: str, value: str):
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def clusters(sites: DataFrame, max_gap: int, tile: int = TILE) -> DataFrame:
    """``sites`` (with ``chr, pos, probe_id``) and ``cluster``, the position at which their cluster starts.

    A new cluster starts where the distance to the site before is over ``max_gap``.
    """
    rows = sites.withColumn("_tile", F.floor(F.col("pos") / tile))
    ends = rows.groupBy("chr", "_tile").agg(F.max("pos").alias("_last"))  # one row per tile
    ends = ends.select("chr", "_tile", _before_tile(ends, ["chr"], "_tile", "_last").alias("_prev"))
    inside = Window.partitionBy("chr", "_tile").orderBy("pos", "probe_id")
    rows = rows.join(F.broadcast(ends), ["chr", "_tile"]).withColumn("_gap", F.col("pos") - F.coalesce(F.lag("pos").over(inside), "_prev"))
    rows = rows.withColumn("_start", F.when(F.col("_gap").isNull() | (F.col("_gap") > max_gap), F.col("pos")))
    rows = rows.withColumn("_open", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    opened = rows.groupBy("chr", "_tile").agg(F.max("_start").alias("_s"))
    opened = opened.select("chr", "_tile", _before_tile(opened, ["chr"], "_tile", "_s").alias("_carried"))
    rows = rows.join(F.broadcast(opened), ["chr", "_tile"])
    return rows.withColumn("cluster", F.coalesce("_open", "_carried")).drop("_tile", "_prev", "_gap", "_start", "_open", "_carried")


def find_regions(dms: DataFrame, annotation: DataFrame, chr_col: str = "chr", pos_col: str = "pos", pval: str = "padj", pval_thresh: float = 0.05, delta: str = "delta_beta",
                 lfc: str = "logFC", max_gap: int = 500, min_cpgs: int = 3, merge_distance: int | None = None, merge_mean: str = "sequential") -> DataFrame:
    """``chr, start, end, n_cpgs, mean_delta_beta, mean_logFC, min_padj, cpgs`` of each cluster of at least ``min_cpgs`` significant sites."""
    sites = dms.join(annotation.select("probe_id", clean_chromosome(chr_col).alias("chr"), F.col(pos_col).cast("bigint").alias("pos")), "probe_id")
    sites = sites.where(F.coalesce(F.when(~F.isnan(pval), F.col(pval)), F.lit(1.0)) <= pval_thresh)
    none = F.lit(None).cast("double")
    sites = sites.select("probe_id", "chr", "pos", F.col(pval).alias("_p"), (F.col(delta) if delta in dms.columns else none).alias("_d"), (F.col(lfc) if lfc in dms.columns else none).alias("_l"))
    found = clusters(sites, max_gap).groupBy("chr", "cluster").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n_cpgs"), F.avg("_d").alias("mean_delta_beta"), F.avg("_l").alias("mean_logFC"),
        F.min("_p").alias("min_padj"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "probe_id"))), lambda x: x["probe_id"]).alias("cpgs"))
    found = found.where(F.col("n_cpgs") >= min_cpgs).drop("cluster")
    return merge_regions(found, merge_distance, merge_mean) if merge_distance else found


def merge_regions(regions: DataFrame, distance: int, mean: str = "sequential", tile: int = TILE) -> DataFrame:
    """Regions joined where the next starts at most ``distance`` after the end so far.

    Means are combined region by region, each step the mean of the two ("sequential"), or weighted by sites ("weighted").
    """
    if mean not in ("sequential", "weighted"):
        raise ValueError(f"unknown mean {mean!r}")
    # As with sites, a tile's regions look at what the tiles before it reach, of which a table has one row each.
    rows = regions.withColumn("_tile", F.floor(F.col("start") / tile))
    before = Window.partitionBy("chr").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("chr", "_tile").agg(F.max("end").alias("_end"))
    reach = reach.select("chr", "_tile", F.max("_end").over(before).alias("_reach"))
    inside = Window.partitionBy("chr", "_tile").orderBy("start", "end")
    far = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    rows = rows.join(F.broadcast(reach), ["chr", "_tile"]).withColumn("_far", far)
    new = F.col("_far").isNull() | (F.col("start") - F.col("_far") > distance)
    rows = rows.withColumn("_first", F.when(new, F.col("start")))  # no later region starts there, or it would be in reach
    opened = rows.groupBy("chr", "_tile").agg(F.max("_first").alias("_s"))
    opened = opened.select("chr", "_tile", F.max("_s").over(before).alias("_carried"))
    rows = rows.join(F.broadcast(opened), ["chr", "_tile"])
    rows = rows.withColumn("_id", F.coalesce(F.last("_first", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_carried"))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "n_cpgs", "mean_delta_beta", "mean_logFC", "cpgs")))

    def folded(column: str):
        if mean == "weighted":
            n = F.sum(F.when(F.col(column).isNotNull(), F.col("n_cpgs")))
            return F.try_divide(F.sum(F.col(column) * F.col("n_cpgs")), n)
        values = F.transform(parts, lambda x: x[column])
        pair = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.get(values, F.lit(0)), pair)

    return rows.groupBy("chr", "_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_cpgs").alias("n_cpgs"), folded("mean_delta_beta").alias("mean_delta_beta"),
        folded("mean_logFC").alias("mean_logFC"), F.min("min_padj").alias("min_padj"), F.flatten(F.transform(parts, lambda x: x["cpgs"])).alias("cpgs")).drop("_id")


def summarize_regions(regions: DataFrame) -> DataFrame:
    """One row: number, median length (cut to a whole number), mean sites and difference, least p-value; zeros without regions."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    middle = quantile(regions, F.col("end") - F.col("start"), 0.5, out="_middle")
    one = regions.agg(F.count("*").alias("n_regions"), zero(F.avg("n_cpgs")).alias("mean_n_cpgs"), zero(F.avg("mean_delta_beta")).alias("mean_delta_beta"), zero(F.min("min_padj")).alias("min_padj"))
    return one.crossJoin(F.broadcast(middle)).select("n_regions", F.coalesce(F.col("_middle").cast("bigint"), F.lit(0)).alias("median_length"), "mean_n_cpgs", "mean_delta_beta", "min_padj")  # one row each
