"""Gene sets, pathway scores and correlation with expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.special import fisher_pvalue, t_pvalue
from cytolake.operators.multitest import adjust
from cytolake.operators.summaries import average_rank


def enrichment(genes: DataFrame, sets: DataFrame, background: DataFrame | None = None, min_size: int = 5, max_size: int = 500, cutoff: float | None = 0.05) -> DataFrame:
    """``term, overlap, set_size, odds_ratio, pvalue, padj`` of over-represented sets, by Fisher's one-sided test.

    ``genes``: ``gene``; ``sets``: ``term, gene``; the background is by default all genes of the sets. A set's size
    is counted in the background and must be between the bounds; the gene list is not cut to the background, and
    sets for which a cell of the table would be negative are left out.
    """
    listed = genes.select("gene").distinct()
    pairs = sets.select("term", "gene").distinct()
    ground = (pairs if background is None else background).select("gene").distinct()
    totals = listed.agg(F.count("*").alias("n_genes")).crossJoin(ground.agg(F.count("*").alias("n_ground")))  # one row
    rows = pairs.join(ground, "gene").join(listed.withColumn("_in", F.lit(1)), "gene", "left")
    by = rows.groupBy("term").agg(F.count("*").alias("set_size"), F.count("_in").alias("overlap")).where(F.col("set_size").between(min_size, max_size))
    by = by.crossJoin(F.broadcast(totals))
    a, b, c = F.col("overlap"), F.col("set_size") - F.col("overlap"), F.col("n_genes") - F.col("overlap")
    d = F.col("n_ground") - a - b - c
    tested = by.where((b >= 0) & (c >= 0) & (d >= 0))
    odds = F.when(b * c == 0, F.lit(float("inf"))).otherwise((a * d).cast("double") / F.when(b * c != 0, (b * c).cast("double")))
    out = tested.select("term", "overlap", "set_size", odds.alias("odds_ratio"), fisher_pvalue("overlap", "set_size", "n_genes", a + b + c + d).alias("pvalue"))
    out = adjust(out, "pvalue").select("term", "overlap", "set_size", "odds_ratio", "pvalue", "padj")
    return out if cutoff is None else out.where(F.col("padj") <= cutoff)


def pathway_scores(cells: DataFrame, probe_gene: DataFrame, sets: DataFrame, method: str = "mean") -> DataFrame:
    """``sample_id, pathway, score``: mean, median or sum over the probes of a pathway's genes; pathways without any are left out."""
    how = {"mean": F.avg, "median": F.median, "sum": F.sum}
    if method not in how:
        raise ValueError(f"unknown method {method!r}")
    members = probe_gene.select("probe_id", "gene").join(sets.select(F.col("term").alias("pathway"), "gene").distinct(), "gene").select("probe_id", "pathway").distinct()
    return cells.join(members, "probe_id").groupBy("sample_id", "pathway").agg(how[method]("value").alias("score"))


def correlate(beta: DataFrame, expression: DataFrame, method: str = "pearson", gene_map: DataFrame | None = None) -> DataFrame:
    """``feature, r, pvalue, n`` over the samples that both have; with ``gene_map`` (``probe_id, gene``) a gene's probes each meet it.

    ``expression``: cells with the feature as ``probe_id``. Features with fewer than two common samples are left out.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    left = beta.select(F.col("probe_id").alias("feature"), F.col("probe_id").alias("other"), "sample_id", F.col("value").alias("x"))
    if gene_map is not None:
        left = beta.join(gene_map.select("probe_id", "gene"), "probe_id").select(F.col("probe_id").alias("feature"), F.col("gene").alias("other"), "sample_id", F.col("value").alias("x"))
    right = expression.select(F.col("probe_id").alias("other"), "sample_id", F.col("value").alias("y"))
    both = left.join(right, ["other", "sample_id"]).where("x is not null and y is not null")
    if method == "spearman":
        both = both.select("feature", average_rank("x", ["feature"]).alias("x"), average_rank("y", ["feature"]).alias("y"))
    by = both.groupBy("feature").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where("n >= 2")
    r = F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0))
    t = F.abs(r) * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return by.select("feature", r.alias("r"), F.when(F.col("n") > 2, t_pvalue(t, (F.col("n") - 2).cast("double"))).alias("pvalue"), "n")
