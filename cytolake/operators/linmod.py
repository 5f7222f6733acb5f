"""Per-probe linear models with moderated variances.

The fit is one pass over packed rows (an array per probe): each Arrow batch is one
matrix, all probes without a missing cell are fitted by one product, and the others
share a decomposition per pattern of missing cells.  Everything global is small: the
variance prior is three aggregates, and adjustment is in
:mod:`cytolake.operators.multitest`.

Packed rows, designs and lists of samples take few samples.  Where samples are many and fall into
groups, :func:`fit_groups` fits long cells from the counts, means and squares of each
probe's groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.expressions import null_if_nan
from cytolake.functions.special import digamma, f_pvalue, t_pvalue, trigamma_inverse
from cytolake.operators.model import flat, nested
from cytolake.operators.multitest import adjust
from cytolake.operators.ranks import quantile

#: Prior degrees of freedom where the variances give no estimate.
FALLBACK_DF = 1e6


@dataclass(frozen=True)
class Prior:
    """Degrees of freedom and variance of the prior."""

    df: float
    variance: float


def _winsorized(y: np.ndarray, lower: float, upper: float) -> np.ndarray:
    """Rows kept between their own quantiles; NaN stays."""
    with np.errstate(all="ignore"):
        lo, hi = np.nanquantile(y, [lower, upper], axis=1)
    return np.clip(y, lo[:, None], hi[:, None])


def fit_rows(y: np.ndarray, x: np.ndarray, contrasts: np.ndarray, robust: bool, lower: float, upper: float, min_count: int, missing: str, whole: bool) -> dict[str, np.ndarray]:
    """Fit every row of ``y``; rows that can't be fitted have NaN.

    ``whole``: no cell of the whole matrix is missing. Coefficients are then those of the values as they are, and
    only residuals are those of winsorised ones; otherwise both are of winsorised ones. ``missing``: "ols" fits
    the present cells; "reference" uses the inverse of the whole design for them.
    """
    m, n = y.shape
    rank = np.linalg.matrix_rank(x)
    inverse = np.linalg.pinv(x.T @ x)
    least = max(min_count, rank + 1)
    present = ~np.isnan(y)
    n_obs = present.sum(axis=1)
    out = {k: np.full(m, np.nan) for k in ("s2", "df_resid")} | {"beta": np.full((m, len(contrasts)), np.nan), "n_obs": n_obs, "residuals": np.full((m, n), np.nan)}
    fit = n_obs >= least
    if not fit.any():
        return out
    z = y.copy()
    some = fit & (n_obs > 2)
    if robust and some.any():
        z[some] = _winsorized(y[some], lower, upper)
    with np.errstate(all="ignore"):
        fit[fit] = np.nanvar(z[fit], axis=1) >= 1e-12
    rows = np.flatnonzero(fit)
    patterns, which = np.unique(present[rows], axis=0, return_inverse=True)
    for k, mask in enumerate(patterns):
        own = rows[which.ravel() == k]
        xo = x[mask]
        ro = np.linalg.matrix_rank(xo) if not mask.all() else rank
        inv = inverse if mask.all() or missing == "reference" and ro == rank else np.linalg.pinv(xo.T @ xo)
        raw = y[own][:, mask] if whole and ro == x.shape[1] else z[own][:, mask]
        b = raw @ xo @ inv.T
        res = z[own][:, mask] - b @ xo.T
        df = mask.sum() - ro
        if df > 0:
            out["s2"][own] = (res * res).sum(axis=1) / df
            out["df_resid"][own] = df
            out["beta"][own] = b @ contrasts.T
            full = np.full((own.size, n), np.nan)
            full[:, mask] = res
            out["residuals"][own] = full
    return out


def fitted(packed: DataFrame, design: pd.DataFrame, contrasts: np.ndarray, robust: bool = True, lower: float = 0.05, upper: float = 0.95,
           min_count: int = 3, missing: str = "ols", whole: bool | None = None, residuals: bool = False) -> DataFrame:
    """``probe_id, effects, s2, n_obs, df_resid`` (and ``residuals``) of the probes that could be fitted."""
    x = design.to_numpy(float)
    if np.linalg.matrix_rank(x) >= len(x):
        raise ValueError(f"{len(x)} samples are too few for a design of rank {np.linalg.matrix_rank(x)}")
    if missing not in ("ols", "reference"):
        raise ValueError(f"unknown treatment of missing cells: {missing!r}")
    if whole is None:  # one cheap aggregate decides for the matrix, as its result doesn't depend on partitions
        whole = packed.where(F.exists("values", lambda v: v.isNull())).limit(1).count() == 0
    types = [("probe_id", pa.string()), ("effects", pa.list_(pa.float64())), ("s2", pa.float64()), ("n_obs", pa.int64()), ("df_resid", pa.float64())]
    ddl = "probe_id string, effects array<double>, s2 double, n_obs bigint, df_resid double" + (", residuals array<double>" if residuals else "")
    schema = pa.schema(types + ([("residuals", pa.list_(pa.float64()))] if residuals else []))
    contrasts = np.atleast_2d(contrasts)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = flat(b.column(1), len(x))
            got = fit_rows(y, x, contrasts, robust, lower, upper, min_count, missing, whole)
            ok = np.flatnonzero(np.isfinite(got["s2"]) & (got["df_resid"] > 0))
            arrays = [b.column(0).take(pa.array(ok)), nested(got["beta"][ok]), pa.array(got["s2"][ok]),
                      pa.array(got["n_obs"][ok].astype(np.int64)), pa.array(got["df_resid"][ok])]
            if residuals:
                arrays.append(nested(got["residuals"][ok]))
            yield pa.record_batch(arrays, schema=schema)

    return packed.select("probe_id", "values").mapInArrow(run, ddl)


def smyth_prior(fit: DataFrame, robust: bool = True, by: list[str] | None = None) -> DataFrame:
    """``middle, spread, n`` of the logarithms of the positive variances: what the prior is solved from. Groups of ``by`` are small."""
    rows, log = fit.where("s2 > 0"), F.log("s2")
    if by or not robust:
        return rows.groupBy(*(by or [])).agg((F.median(log) if robust else F.avg(log)).alias("middle"), F.var_samp(log).alias("spread"), F.count("*").alias("n"))
    moments = rows.agg(F.var_samp(log).alias("spread"), F.count("*").alias("n"))
    return quantile(rows, log, 0.5, out="middle").crossJoin(F.broadcast(moments))  # one row each


def solve_prior(middle: float | None, spread: float | None, n: int) -> Prior:
    """Prior from the moments of the log variances: ``trigamma(df / 2) = spread``; without spread, a very large df."""
    if not n:
        raise ValueError("no positive variance")
    if n == 1 or spread is None or spread <= 0:
        return Prior(FALLBACK_DF, math.exp(middle))
    half = trigamma_inverse(spread)
    if half is None:
        return Prior(FALLBACK_DF, math.exp(middle))
    return Prior(2 * half, math.exp(middle - digamma(half) + math.log(half)))


def choose_prior(fit: DataFrame, shrink, n_samples: int, max_d0: float = 50.0, robust: bool = True, lower: float = 0.05, upper: float = 0.95) -> Prior:
    """The prior for ``shrink``: "none", "median", "smyth", a number of degrees of freedom, or "auto" by the number of samples."""
    def middle() -> float:
        # The median isn't moved by winsorising both sides.
        return quantile(fit, "s2", 0.5).first()[0]

    if shrink == "auto":
        if n_samples < 10:
            shrink = "none"
        elif n_samples < 30:
            spread = fit.where("s2 > 0").agg(F.var_samp(F.log("s2"))).first()[0]
            shrink = 10.0 if spread is not None and spread < 0.05 else "smyth"
        else:
            shrink = "smyth"
    if shrink is None or shrink == "none":
        return Prior(0.0, 0.0)
    if isinstance(shrink, (int, float)):
        return Prior(min(float(shrink), max_d0), middle())
    if shrink == "median":
        return Prior(min(max(2.0, n_samples / 2), max_d0), middle())
    if shrink == "smyth":
        r = smyth_prior(fit, robust).first()
        got = solve_prior(r.middle, r.spread, r.n)
        return Prior(min(got.df, max_d0), got.variance)
    raise ValueError(f"unknown shrinkage {shrink!r}")


def moderated(fit: DataFrame, prior: Prior) -> DataFrame:
    """``fit`` with ``s2_post, d0, df_total``."""
    d0, s0 = F.lit(float(prior.df)), F.lit(float(prior.variance))
    post = F.when(d0 > 0, F.greatest((d0 * s0 + F.col("df_resid") * F.col("s2")) / (d0 + F.col("df_resid")), F.lit(1e-12))).otherwise(F.col("s2"))
    return fit.withColumn("s2_post", post).withColumn("d0", d0).withColumn("df_total", F.col("df_resid") + d0)


def t_test(fit: DataFrame, unscaled: float, eps: float = 1e-8, method: str = "fdr_bh") -> DataFrame:
    """``logFC, se, t, pval, padj`` of the first effect; ``unscaled`` is ``c (X'X)^- c``. A standard error under 1e-3 gives t = 0."""
    se = F.sqrt(F.greatest(F.lit(float(unscaled)) * F.col("s2_post"), F.lit(eps)))
    out = fit.withColumn("logFC", F.col("effects")[0]).withColumn("se", se)
    out = out.withColumn("t", F.when(F.col("se") < 1e-3, 0.0).otherwise(F.col("logFC") / F.col("se"))).withColumn("pval", t_pvalue("t", "df_total"))
    return adjust(out, "pval", "padj", method).drop("effects")


def f_test(fit: DataFrame, unscaled: np.ndarray, eps: float = 1e-8, method: str = "fdr_bh") -> DataFrame:
    """``F, df1, df2, pval, padj`` of all effects together; ``unscaled`` is ``R (X'X)^- R'``."""
    inner = np.linalg.pinv(np.atleast_2d(unscaled))
    r = inner.shape[0]
    e = lambda i: F.col("effects")[i]
    quadratic = sum((e(i) * e(j) * float(inner[i, j]) for i in range(r) for j in range(r)), F.lit(0.0))
    out = fit.withColumn("F", quadratic / r / F.greatest("s2_post", F.lit(eps))).withColumn("df1", F.lit(float(r))).withColumn("df2", F.col("df_total"))
    return adjust(out.withColumn("pval", f_pvalue("F", "df1", "df2")), "pval", "padj", method).drop("effects")


def fit_differential(packed: DataFrame, design: pd.DataFrame, contrast=None, contrast_matrix=None, shrink="auto", robust: bool = True, eps: float = 1e-8,
                     min_count: int = 3, max_d0: float = 50.0, winsor: tuple[float, float] = (0.05, 0.95), missing: str = "ols", residuals: bool = False, keep: bool = True, whole: bool | None = None) -> DataFrame:
    """The whole test of every probe of a packed matrix: fit, prior, moderation, t (a vector) or F (a matrix of contrasts).

    Neither contrast gives the variance columns alone; both raise a ValueError, as does a matrix without any row
    that can be fitted. The fit, a few numbers per probe, is read several times (prior, adjustment, result): with
    ``keep`` it is persisted, in memory and on disk, until :func:`release` of the result, and a lost part is fitted anew. ``whole`` says that no cell of
    the matrix is missing, where that is known; else one aggregate finds out.
    """
    if contrast is not None and contrast_matrix is not None:
        raise ValueError("give one contrast or a matrix of them, not both")
    x = design.to_numpy(float)
    rows = np.atleast_2d(np.asarray(contrast_matrix if contrast_matrix is not None else contrast if contrast is not None else np.zeros(x.shape[1]), float))
    fit = fitted(packed, design, rows, robust, *winsor, min_count=min_count, missing=missing, whole=whole, residuals=residuals)
    if keep:
        fit = base = fit.persist(StorageLevel.MEMORY_AND_DISK)
    prior = choose_prior(fit, shrink, len(x), max_d0, robust, *winsor)
    fit = moderated(fit, prior)
    unscaled = rows @ np.linalg.pinv(x.T @ x) @ rows.T
    if contrast is not None:
        out = t_test(fit, float(unscaled[0, 0]), eps)
    elif contrast_matrix is not None:
        out = f_test(fit, unscaled, eps)
    else:
        out = fit.drop("effects")
    out._fit = base if keep else None
    return out


def _group_moments(cells: DataFrame, levels: list, robust: bool, lower: float, upper: float) -> DataFrame:
    """``probe_id, g, c, m, mz, ss``: of each probe's group (the number of its level) the present cells, their mean, and the mean
    and the squares about it of the winsorised ones."""
    number = F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (v, k)])
    rows = cells.select("probe_id", number[F.col("group")].alias("g"), null_if_nan("value").alias("y")).where("g is not null and y is not null")
    z = F.col("y")
    if robust:
        ends = quantile(rows, "y", lower, ["probe_id"], "lo").join(quantile(rows, "y", upper, ["probe_id"], "hi"), "probe_id")
        rows, z = rows.join(F.broadcast(ends), "probe_id"), F.least(F.greatest("y", "lo"), F.col("hi"))  # a row for each probe
    return rows.withColumn("z", z).groupBy("probe_id", "g").agg(F.count("*").alias("c"), F.avg("y").alias("m"), F.avg("z").alias("mz"), (F.var_pop("z") * F.count("*")).alias("ss"))


def fitted_groups(cells: DataFrame, sizes: dict, contrasts: np.ndarray, robust: bool = True, lower: float = 0.05, upper: float = 0.95, min_count: int = 3, missing: str = "ols", keep: bool = True) -> DataFrame:
    """The same as :func:`fitted` for a design of an intercept and all levels of ``group`` but the first, from long cells
    (``probe_id, sample_id, value, group``). ``sizes``: the number of samples of each level.

    Samples may be any number; probes and levels are few enough for a row of each two. Cells without a group don't count.
    """
    if missing not in ("ols", "reference"):
        raise ValueError(f"unknown treatment of missing cells: {missing!r}")
    levels, n_samples = sorted(sizes), sum(sizes.values())
    if len(levels) < 2:
        raise ValueError("a single group has no difference")
    if n_samples <= len(levels):
        raise ValueError(f"{n_samples} samples are too few for a design of rank {len(levels)}")
    moments = _group_moments(cells, levels, robust, lower, upper)
    if keep:
        moments = moments.persist(StorageLevel.MEMORY_AND_DISK)
    whole = moments.groupBy("probe_id").agg(F.sum("c").alias("n")).where(F.col("n") < n_samples).limit(1).count() == 0
    x = np.hstack([np.ones((len(levels), 1)), np.eye(len(levels))[:, 1:]])  # one row for each level
    inverse = np.linalg.pinv(x.T @ (x * np.array([sizes[v] for v in levels], float)[:, None]))
    contrasts, ddl = np.atleast_2d(contrasts), "probe_id string, effects array<double>, s2 double, n_obs bigint, df_resid double"
    schema = pa.schema([("probe_id", pa.string()), ("effects", pa.list_(pa.float64())), ("s2", pa.float64()), ("n_obs", pa.int64()), ("df_resid", pa.float64())])

    def run(batches):
        for b in batches:
            out = []
            for probe, groups in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g, c, m, mz, ss = (np.array([r[k] for r in groups], int if k == "g" else float) for k in ("g", "c", "m", "mz", "ss"))
                n, rank, xo = int(c.sum()), g.size, x[g]
                mean = (c * mz).sum() / n
                if n < max(min_count, len(levels) + 1) or (ss.sum() + (c * (mz - mean) ** 2).sum()) / n < 1e-12 or n <= rank:
                    continue
                full = n == n_samples
                inv = inverse if full or missing == "reference" and rank == len(levels) else np.linalg.pinv(xo.T @ (xo * c[:, None]))
                beta = (c * (m if whole and rank == len(levels) else mz)) @ xo @ inv.T
                s2 = (ss + c * (mz - xo @ beta) ** 2).sum() / (n - rank)
                out.append((probe, (contrasts @ beta).tolist(), float(s2), n, float(n - rank)))
            yield pa.record_batch([pa.array([r[i] for r in out], schema.field(i).type) for i in range(5)], schema=schema)

    fit = moments.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("g", "c", "m", "mz", "ss"))).alias("groups")).mapInArrow(run, ddl)
    fit._moments = moments if keep else None
    return fit


def fit_groups(cells: DataFrame, samples: DataFrame, shrink="auto", robust: bool = True, eps: float = 1e-8, min_count: int = 3, max_d0: float = 50.0,
               winsor: tuple[float, float] = (0.05, 0.95), missing: str = "ols", keep: bool = True) -> DataFrame:
    """The moderated F-test for any difference between groups, from long cells (``probe_id, sample_id, value, group``) of any number of samples.

    It is :func:`fit_differential` with all effects of a design of groups as contrasts, without an array or a literal for each sample.
    ``samples`` (``sample_id, group``) has each once, else a KeyError; those without a group aren't used.
    """
    twice = [r[0] for r in samples.groupBy("sample_id").count().where("count > 1").orderBy("sample_id").select("sample_id").limit(5).collect()]
    if twice:
        raise KeyError(f"repeated samples: {twice}")
    sizes = {r["group"]: r["count"] for r in samples.where(F.col("group").isNotNull()).groupBy("group").count().collect()}
    rows, n = np.eye(len(sizes))[1:], np.array([sizes[v] for v in sorted(sizes)], float)
    fit = base = fitted_groups(cells, sizes, rows, robust, *winsor, min_count=min_count, missing=missing, keep=keep)
    fit = moderated(fit, choose_prior(fit, shrink, int(n.sum()), max_d0, robust, *winsor))
    x = np.hstack([np.ones((n.size, 1)), np.eye(n.size)[:, 1:]])
    out = f_test(fit, rows @ np.linalg.pinv(x.T @ (x * n[:, None])) @ rows.T, eps)
    out._fit = base._moments
    return out


def release(result: DataFrame) -> None:
    """Give back the storage of the fit behind a result of :func:`fit_differential`, :func:`fit_chunked` or :func:`fit_groups`."""
    kept = getattr(result, "_fit", None)
    if kept is not None:
        kept.unpersist()


def fit_chunked(packed: DataFrame, design: pd.DataFrame, contrast, chunk: int = 10_000, robust: bool = True, eps: float = 1e-8, max_d0: float = 50.0) -> DataFrame:
    """The t-test with a variance prior of its own for each chunk of about ``chunk`` probes.

    Chunks are of about equal size, by a hash of the id; the chunks' moments are one row each.
    """
    x, c = design.to_numpy(float), np.asarray(contrast, float)
    fit = base = fitted(packed, design, c, robust).persist(StorageLevel.MEMORY_AND_DISK)
    probes = fit.select("probe_id")
    n = max(1, probes.count() // chunk)
    # Chunks of about equal size by a hash of the id: a probe's chunk doesn't depend on the others.
    digest = F.conv(F.substring(F.md5(F.col("probe_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    fit = fit.withColumn("chunk", (digest % n).cast("int"))
    priors = [(r.chunk, *_capped(solve_prior(r.middle, r.spread, r.n), max_d0)) for r in smyth_prior(fit, robust, ["chunk"]).collect()]
    small = packed.sparkSession.createDataFrame(priors, "chunk int, d0 double, s0 double")
    joined = fit.join(F.broadcast(small), "chunk")
    post = F.greatest((F.col("d0") * F.col("s0") + F.col("df_resid") * F.col("s2")) / (F.col("d0") + F.col("df_resid")), F.lit(1e-12))
    out = joined.withColumn("s2_post", post).withColumn("df_total", F.col("df_resid") + F.col("d0")).drop("s0")
    out = t_test(out, float(c @ np.linalg.pinv(x.T @ x) @ c), eps)
    out._fit = base
    return out


def _capped(prior: Prior, most: float) -> tuple[float, float]:
    return min(prior.df, most), prior.variance
