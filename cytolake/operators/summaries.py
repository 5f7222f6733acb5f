"""Group means, effect sizes and summaries of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.operators.filters import with_groups
from cytolake.operators.ranks import edges, quantile, range_of


def group_means(cells: DataFrame, groups: DataFrame, levels: list[str]) -> DataFrame:
    """``probe_id`` and ``mean_{level}`` for each level of ``groups`` (``sample_id, group``)."""
    rows = with_groups(cells, groups)
    return rows.groupBy("probe_id").agg(*[F.avg(F.when(F.col("group") == g, F.col("value"))).alias(f"mean_{g}") for g in levels])


def group_means_long(rows: DataFrame, group: str, value: str, levels: list[str]) -> DataFrame:
    """Every row with the mean of its own group in that group's column and null in the others'."""
    means = rows.groupBy(group).agg(F.avg(value).alias("_mean"))  # one row per level
    return rows.join(F.broadcast(means), group, "left").select(*rows.columns, *[F.when(F.col(group) == g, F.col("_mean")).alias(f"mean_{g}") for g in levels])


def summarize_groups(cells: DataFrame, groups: DataFrame, levels: list[str], summary: Callable[[Column], Column] = F.avg) -> DataFrame:
    """``mean_{level}`` (any aggregate of a column) and ``var_{level}`` per probe."""
    rows, out = with_groups(cells, groups), []
    for g in levels:
        own = F.when(F.col("group") == g, F.col("value"))
        out += [summary(own).alias(f"mean_{g}"), F.var_samp(own).alias(f"var_{g}")]
    return rows.groupBy("probe_id").agg(*out)


def delta(a: DataFrame, b: DataFrame, key: str, column: str, as_abs: bool = False) -> DataFrame:
    """``key, delta``: ``a - b`` for the keys of ``a``; null where ``b`` lacks one."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key, "left")
    d = F.col("_a") - F.col("_b")
    return both.select(key, (F.abs(d) if as_abs else d).alias("delta"))


def effect_size(cells: DataFrame, groups: DataFrame, a: str, b: str, n_a: int, n_b: int, method: str = "cohens_d") -> DataFrame:
    """``probe_id, effect``: the difference of two groups' means by their pooled spread, 0 without spread.

    ``n_a`` and ``n_b`` are the groups' numbers of samples, missing cells included.
    """
    if method not in ("cohens_d", "hedges_g"):
        raise ValueError(f"unknown method {method!r}")
    rows = with_groups(cells, groups)
    own = lambda g: F.when(F.col("group") == g, F.col("value"))
    by = rows.groupBy("probe_id").agg(F.avg(own(a)).alias("ma"), F.avg(own(b)).alias("mb"), F.var_samp(own(a)).alias("va"), F.var_samp(own(b)).alias("vb"))
    sd = F.sqrt((F.lit(float(n_a - 1)) * F.col("va") + F.lit(float(n_b - 1)) * F.col("vb")) / F.lit(float(n_a + n_b - 2)))
    d = F.coalesce(F.when(sd != 0, (F.col("ma") - F.col("mb")) / sd), F.lit(0.0))
    correction = 1 - 3 / (4 * (n_a + n_b) - 9) if method == "hedges_g" else 1.0
    return by.select("probe_id", (d * F.lit(correction)).alias("effect"))


def _p(pval: str) -> Column:
    """A p-value with missing as 1."""
    return F.coalesce(F.when(~F.isnan(pval), F.col(pval)), F.lit(1.0))


def _effect(lfc: Column, threshold: float, direction: str | None) -> Column:
    if direction not in (None, "hyper", "hypo"):
        raise ValueError(f"unknown direction {direction!r}")
    return lfc >= threshold if direction == "hyper" else lfc <= -threshold if direction == "hypo" else F.abs(lfc) >= threshold


def filter_dms(res: DataFrame, lfc: str = "logFC", pval: str = "padj", pval_thresh: float = 0.05, lfc_thresh: float = 0.0,
               delta_col: str | None = None, delta_thresh: float | None = None, direction: str | None = None) -> DataFrame:
    """Results at most at a p-value and at least at an effect, in a direction."""
    if pval not in res.columns:
        raise KeyError(pval)
    keep = (_p(pval) <= pval_thresh) & _effect(F.col(lfc), lfc_thresh, direction)
    if delta_col is not None and delta_thresh is not None:
        keep = keep & (F.abs(delta_col) >= delta_thresh)
    return res.where(keep)


def significant(res: DataFrame, lfc: str = "logFC", pval: str = "padj", lfc_thresh: float = 0.0, pval_thresh: float = 0.05, delta_thresh: float | None = None,
                direction: str | None = None, delta_cols: tuple[str, str] | None = None) -> DataFrame:
    """Results strictly under a p-value; a missing effect counts as 0. The difference of two mean columns may be asked for too."""
    keep = (_p(pval) < pval_thresh) & _effect(F.coalesce(lfc, F.lit(0.0)), lfc_thresh, direction)
    if delta_thresh is not None:
        cols = delta_cols or tuple(c for c in res.columns if c.startswith(("meanB_", "meanM_", "mean_")))
        if len(cols) != 2:
            raise ValueError(f"two mean columns are needed, not {list(cols)}")
        keep = keep & (F.abs(F.col(cols[0]) - F.col(cols[1])) >= delta_thresh)
    return res.where(keep)


def summarize_results(res: DataFrame, pval_thresh: float = 0.05, lfc_thresh: float = 0.0) -> DataFrame:
    """One row of counts and medians of a results table; zeros for an empty one. A zero effect counts both ways at threshold 0."""
    if not 0 < pval_thresh <= 1:
        raise ValueError(f"a threshold over 0 and at most 1 is needed, not {pval_thresh}")
    sig, lfc = _p("padj") < pval_thresh, F.col("logFC")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n, n_sig = F.count("*"), F.count_if(sig)
    counts = res.agg(
        n.alias("total_tested"), n_sig.alias("significant"), F.count_if(sig & (lfc >= lfc_thresh)).alias("hypermethylated"),
        F.count_if(sig & (lfc <= -lfc_thresh)).alias("hypomethylated"), zero(F.when(n > 0, n_sig / n)).alias("pct_significant"),
        zero(F.avg(F.when(sig, F.abs(lfc)))).alias("mean_abs_logFC"), zero(F.max(F.abs(lfc))).alias("max_abs_logFC"), zero(F.min("pval")).alias("min_pval"))
    for name, value in (("_lfc", F.abs(lfc)), ("_post", "s2_post"), ("_s2", "s2"), ("_d0", "d0")):
        counts = counts.crossJoin(F.broadcast(quantile(res, value, 0.5, out=name)))  # one row each
    return counts.select("total_tested", "significant", "hypermethylated", "hypomethylated", "pct_significant", "mean_abs_logFC", zero("_lfc").alias("median_abs_logFC"),
                         "max_abs_logFC", "min_pval", zero(F.try_divide("_post", "_s2")).alias("shrinkage_factor"), zero("_d0").alias("median_d0"))


def average_rank(value: str, partition: list[str]) -> Column:
    """The rank of a value, with equal ones given their mean rank."""
    w = Window.partitionBy(*partition).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def reproducibility(a: DataFrame, b: DataFrame, effect: str = "logFC", pval: str = "padj", pval_thresh: float = 0.05) -> DataFrame:
    """One row: sizes, overlap, Jaccard, overlap of the significant, agreement of signs and Spearman's correlation of effects."""
    for df in (a, b):
        for c in (effect, pval):
            if c not in df.columns:
                raise KeyError(c)
    side = lambda df, s: df.select("probe_id", F.col(effect).alias(f"e{s}"), (_p(pval) < pval_thresh).alias(f"s{s}"))
    both = side(a, 1).join(side(b, 2), "probe_id", "full")
    in_both = F.col("e1").isNotNull() & F.col("e2").isNotNull() | F.col("s1").isNotNull() & F.col("s2").isNotNull()
    one = F.lit(1).alias("_g")
    ranked = both.where(in_both & F.col("e1").isNotNull() & F.col("e2").isNotNull()).select("e1", "e2", one)
    rho = _spearman(ranked)
    counts = both.agg(
        F.count("s1").alias("n1"), F.count("s2").alias("n2"), F.count_if(in_both).alias("n_overlap"),
        F.count_if(in_both).cast("double").alias("_o"), F.count("*").cast("double").alias("_u"),
        F.count_if(F.col("s1")).alias("n_sig1"), F.count_if(F.col("s2")).alias("n_sig2"), F.count_if(F.col("s1") & F.col("s2")).alias("n_sig_overlap"),
        F.avg(F.when(in_both, F.when(F.signum("e1") == F.signum("e2"), 1.0).otherwise(0.0))).alias("sign_concordance"))
    counts = counts.withColumn("jaccard", F.try_divide("_o", "_u")).drop("_o", "_u")
    return counts.crossJoin(F.broadcast(rho))  # one row each


def _spearman(pairs: DataFrame) -> DataFrame:
    """One row: the correlation of mean ranks. Ranks come from the counts of distinct values, so that equal ones are not sorted."""
    def ranks(c):
        n = pairs.groupBy(c).agg(F.count("*").alias("n"))
        n = n.withColumn("g", range_of(c, edges(pairs, c)))
        g = n.groupBy("g").agg(F.sum("n").alias("gn")).withColumn("before", F.coalesce(F.sum("gn").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.sum("n").over(Window.partitionBy("g").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return n.join(g, "g").select(c, (F.col("before") + inside - (F.col("n") - 1) / 2).alias(f"r{c}"))

    both = pairs.join(ranks("e1"), "e1").join(ranks("e2"), "e2")
    return both.agg(F.when(F.count("*") > 2, F.corr("re1", "re2")).alias("spearman"))
