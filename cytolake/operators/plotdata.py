"""Tables from which plots are drawn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.expressions import clean_chromosome
from cytolake.operators.model import flat, pack
from cytolake.operators.ranks import ranked

_SMALLEST = 2.2250738585072014e-308


def _minus_log10(p: str):
    return -F.log10(F.greatest(F.col(p), F.lit(_SMALLEST)))


def volcano(res: DataFrame, lfc: str = "logFC", pval: str = "pval", lfc_thresh: float = 0.0, pval_thresh: float = 0.05) -> DataFrame:
    """``probe_id, logFC, neg_log10_p, class`` with the classes Hyper, Hypo and NS."""
    sig = F.col(pval) < pval_thresh
    kind = F.when(sig & (F.col(lfc) >= lfc_thresh), "Hyper").when(sig & (F.col(lfc) <= -lfc_thresh), "Hypo").otherwise("NS")
    return res.select("probe_id", F.col(lfc).alias("logFC"), _minus_log10(pval).alias("neg_log10_p"), kind.alias("class"))


def qq(res: DataFrame, pval: str = "pval") -> DataFrame:
    """``expected, observed`` of the sorted p-values, as -log10; expected ones are evenly spaced from 1/(n+1) to 1-1/(n+1).

    Ranks are made within ranges of about equally many p-values, whose numbers are summed up in a small table.
    """
    rows = ranked(res.where(F.col(pval).isNotNull() & ~F.isnan(pval)).select("probe_id", F.col(pval).alias("p")), "p", ["probe_id"]).withColumnRenamed("rank_of", "n")
    low = 1 / (F.col("n") + 1)
    expected = F.when(F.col("n") > 1, low + (F.col("rank") - 1) * (1 - 2 * low) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(low)
    return rows.select((-F.log10(expected)).alias("expected"), _minus_log10("p").alias("observed"))


def pvalue_histogram(res: DataFrame, pval: str = "pval", bins: int = 50) -> DataFrame:
    """``bin, low, high, n, null_line`` of equal bins over the values' range; empty bins have 0."""
    rows = res.where(F.col(pval).isNotNull() & ~F.isnan(pval)).select(F.col(pval).alias("p"))
    span = rows.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("total"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    placed = rows.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("p") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
                                                    F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") / bins).alias("null_line"))


def manhattan(res: DataFrame, annotation: DataFrame, pval: str = "pval", chr_col: str = "chr", pos_col: str = "pos") -> DataFrame:
    """``probe_id, chr, x, neg_log10_p`` with ``x`` the chromosome's place (sorted as text) times 1e9, plus the position."""
    rows = res.join(annotation.select("probe_id", clean_chromosome(chr_col).alias("chr"), F.col(pos_col).cast("bigint").alias("pos")), "probe_id")
    order = rows.select("chr").distinct().withColumn("ord", (F.row_number().over(Window.orderBy("chr")) - 1).cast("bigint"))  # one row per chromosome
    return rows.join(F.broadcast(order), "chr").select("probe_id", "chr", (F.col("ord") * F.lit(1_000_000_000) + F.col("pos")).alias("x"), _minus_log10(pval).alias("neg_log10_p"))


def zscores(cells: DataFrame) -> DataFrame:
    """Cells centred and scaled by probe; a spread of 0 is taken as 1."""
    by = cells.groupBy("probe_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("sd")).otherwise(1.0)
    return cells.join(by, "probe_id").select("probe_id", "sample_id", ((F.col("value") - F.col("mean")) / sd).alias("z"))


def heatmap(cells: DataFrame, res: DataFrame, top_n: int = 50, pval: str = "pval") -> DataFrame:
    """Z-scores of the probes with the smallest p-values."""
    top = res.orderBy(F.asc_nulls_last(pval), "probe_id").limit(top_n).select("probe_id")
    return zscores(cells.join(F.broadcast(top), "probe_id", "left_semi"))


def sample_summary(cells: DataFrame, n_probes: int | None = None) -> DataFrame:
    """``sample_id, missing_pct, mean, variance``."""
    total = F.count("*") if n_probes is None else F.lit(n_probes)
    return cells.groupBy("sample_id").agg(((total - F.count("value")) / total * 100).alias("missing_pct"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def mean_variance(cells: DataFrame) -> DataFrame:
    """``probe_id, mean, variance``."""
    return cells.groupBy("probe_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def sample_correlation(cells: DataFrame) -> DataFrame:
    """``sample_a, sample_b, r`` over the probes that both samples have, each pair once and each with itself.

    Numbers, sums, squares and products of all pairs of samples are added up over the packed rows of a task, and then over
    the tasks: ``len(samples)**2`` rows each. Values are taken from the matrix' mean, which doesn't change a correlation.
    """
    samples = [r.sample_id for r in cells.select("sample_id").distinct().orderBy("sample_id").collect()]  # samples are few
    n, middle = len(samples), cells.agg(F.avg("value")).first()[0] or 0.0

    def sums(batches):
        total = np.zeros((4, n, n))
        for b in batches:
            x = flat(b.column(0), n) - middle
            p = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([p.T @ p, x.T @ p, (x * x).T @ p, x.T @ x])
        a, b = np.triu_indices(n)
        sides = [total[0][a, b], total[1][a, b], total[1][b, a], total[2][a, b], total[2][b, a], total[3][a, b]]
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, sides)], names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    sums_ = pack(cells, samples).select("values").mapInArrow(sums, "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    by = sums_.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).where("n > 0")
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    together = F.sqrt(spread("x", "xx") * spread("y", "yy"))
    r = F.when(together > 0, F.greatest(F.least((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / together, F.lit(1.0)), F.lit(-1.0)))
    name = lambda c: F.get(F.array(*map(F.lit, samples)), F.col(c))
    return by.select(name("a").alias("sample_a"), name("b").alias("sample_b"), r.alias("r"))


def mean_difference(cells: DataFrame, groups: DataFrame, a: str, b: str, top_n: int = 50) -> DataFrame:
    """``probe_id, difference, rank`` of the largest differences of two groups' means."""
    from cytolake.operators.summaries import group_means

    d = group_means(cells, groups, [a, b]).select("probe_id", F.abs(F.col(f"mean_{a}") - F.col(f"mean_{b}")).alias("difference")).where("difference is not null")
    top = d.orderBy(F.desc("difference"), "probe_id").limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("difference"), "probe_id")))  # of top_n rows


def shrinkage(fit: DataFrame) -> DataFrame:
    """``probe_id, log_s2, log_s2_post``."""
    return fit.select("probe_id", F.log10(F.col("s2") + 1e-12).alias("log_s2"), F.log10(F.col("s2_post") + 1e-12).alias("log_s2_post"))


def expression_heatmap(correlations: DataFrame, top_n: int = 50, features: list[str] | None = None) -> DataFrame:
    """The strongest correlations, or those of given features; none gives a RuntimeError."""
    if features is not None:
        out = correlations.where(F.col("feature").isin(features))
    else:
        out = correlations.where("r is not null").orderBy(F.desc(F.abs("r")), "feature").limit(top_n)
    if out.limit(1).count() == 0:
        raise RuntimeError("no correlated feature")
    return out


def sample_gram(packed: DataFrame, n: int) -> np.ndarray:
    """Products of the ``n`` samples' values about their probe's mean, which missing cells have; summed over probes in
    the cluster, so that only ``n**2`` numbers come to the driver."""

    def sums(batches):
        total = np.zeros((n, n))
        for b in batches:
            x = flat(b.column(0), n)
            x = x[~np.isnan(x).all(axis=1)]
            x = x - np.nanmean(x, axis=1, keepdims=True)
            x = np.where(np.isnan(x), 0, x)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(n * n)), pa.array(total.ravel())], names=["i", "g"])

    got = packed.select("values").mapInArrow(sums, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").toPandas()
    return got["g"].to_numpy().reshape(n, n) if len(got) else np.zeros((n, n))


def pca(packed: DataFrame, samples: list[str], components: int = 2) -> DataFrame:
    """``sample_id, pc1, ..., explained_1, ...`` of samples over probes, missing cells as their probe's mean."""
    values, vectors = np.linalg.eigh(sample_gram(packed, len(samples)))
    order = np.argsort(-values)[:components]
    scores = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    scores *= np.where(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])] < 0, -1, 1)  # the largest score of each is positive
    share = np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300)
    names = [f"pc{i}" for i in range(1, components + 1)] + [f"explained_{i}" for i in range(1, components + 1)]
    rows = [(s, *map(float, r), *map(float, share)) for s, r in zip(samples, scores)]
    return packed.sparkSession.createDataFrame(rows, ", ".join(["sample_id string", *[f"{c} double" for c in names]]))


def ward(square: np.ndarray) -> tuple[list[tuple[int, int, float, int]], list[int]]:
    """Ward's clustering of points with these squared distances: ``a, b, distance, size`` of each merger (points are
    0, 1, ..., mergers go on from there), and the points in the order of the tree's leaves."""
    n = len(square)
    d, size, name, leaves = square.astype(float).copy(), np.ones(n), list(range(n)), [[i] for i in range(n)]
    np.fill_diagonal(d, np.inf)
    alive, out = list(range(n)), []
    for step in range(n - 1):
        own = d[np.ix_(alive, alive)]
        i, j = sorted(alive[k] for k in divmod(int(np.argmin(own)), len(alive)))
        out.append((*sorted((name[i], name[j])), float(np.sqrt(max(d[i, j], 0))), int(size[i] + size[j])))
        k = np.array([x for x in alive if x not in (i, j)], int)
        d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / (size[i] + size[j] + size[k])
        leaves[i] = leaves[i] + leaves[j] if name[i] < name[j] else leaves[j] + leaves[i]
        size[i], name[i] = size[i] + size[j], n + step
        alive.remove(j)
    return out, leaves[alive[0]] if alive else []


def sample_linkage(packed: DataFrame, samples: list[str]) -> DataFrame:
    """``step, a, b, distance, size, leaf`` of Ward's clustering of samples over probes, missing cells as their probe's mean; ``leaf`` is the
    sample at that place of the tree (which has one more, in a row without a merger). Samples are few: their distances are a small matrix."""
    gram = sample_gram(packed, len(samples))
    square = np.maximum(np.diag(gram)[:, None] + np.diag(gram) - 2 * gram, 0)
    merged, leaves = ward(square)
    rows = [(i, *(merged[i] if i < len(merged) else (None,) * 4), samples[leaf]) for i, leaf in enumerate(leaves)]
    return packed.sparkSession.createDataFrame(rows, "step int, a int, b int, distance double, size int, leaf string")
