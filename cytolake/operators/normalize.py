"""Beta/M conversion, quantile normalisation and batch correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.expressions import beta_to_m, m_to_beta
from cytolake.operators.model import Study, flat, nested, pack, unpack
from cytolake.operators.ranks import quantile, ranked


def convert(study: Study, to: str | None) -> Study:
    """The study in beta values or M-values; nothing to do if it is, or for None."""
    if to is None or to == study.meta.get("matrix_type"):
        return study
    if to not in ("M", "beta"):
        raise ValueError(f"unknown matrix type {to!r}")
    return study.step(study.cells.withColumn("value", beta_to_m("value") if to == "M" else m_to_beta("value")), matrix_type=to)


def quantile_normalized(cells: DataFrame) -> DataFrame:
    """Cells with every sample given the same distribution: the mean over samples at each rank.

    Missing cells take part as their sample's median and come out missing. Ties are ranked by probe_id. Samples
    are sorted in ranges of values, whose numbers a small table adds up; the target has one row per probe and is joined by rank.
    """
    middle = quantile(cells, "value", 0.5, ["sample_id"], "middle")
    filled = cells.join(F.broadcast(middle), "sample_id").withColumn("filled", F.coalesce("value", "middle"))
    rows = ranked(filled, "filled", ["probe_id"], ["sample_id"])
    target = rows.groupBy("rank").agg(F.avg("filled").alias("target"))
    return rows.join(target, "rank").select("probe_id", "sample_id", F.when(F.col("value").isNotNull(), F.col("target")).alias("value"))


def normalize(study: Study, method: str | None = "beta_quantile", convert_to: str | None = None) -> Study:
    """Quantile normalisation (or none) and conversion."""
    if method not in (None, "none", "beta_quantile", "quantile"):
        raise ValueError(f"unknown method {method!r}")
    if method not in (None, "none"):
        study = study.step(quantile_normalized(study.cells), normalized=True, normalization=method)
    return convert(study, convert_to)


def batch_design(pheno: pd.DataFrame, batch: str, covariates: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``X`` (intercept, covariates, batch dummies) and which columns are the batch's."""
    for c in [batch, *(covariates or [])]:
        if c not in pheno.columns:
            raise KeyError(c)
    columns, of_batch = [np.ones(len(pheno))], [False]
    for c in [*(covariates or []), batch]:
        if c != batch and pd.api.types.is_numeric_dtype(pheno[c]) and not pd.api.types.is_bool_dtype(pheno[c]):
            columns.append(pheno[c].to_numpy(float))
            of_batch.append(False)
            continue
        if pheno[c].isna().any():
            raise ValueError(f"missing values in {c}")
        for level in sorted(pheno[c].unique())[1:]:
            columns.append((pheno[c] == level).to_numpy(float))
            of_batch.append(c == batch)
    x = np.column_stack(columns)
    if np.isnan(x).any():
        raise ValueError("missing values among the covariates")
    return x, np.array(of_batch)


def batch_coefficients(y: np.ndarray, x: np.ndarray, robust: bool = False, missing: str = "propagate", bend: float = 1.345, steps: int = 30) -> np.ndarray:
    """Coefficients of every row of ``y`` on the design ``x``, by least squares or, if ``robust``, with Huber's weights.

    A row with a missing cell has none ("propagate"), or those of its present cells ("ols").
    """
    if missing not in ("propagate", "ols"):
        raise ValueError(f"unknown treatment of missing cells: {missing!r}")
    present = ~np.isnan(y)
    if not robust and (missing == "propagate" or present.all()):
        return y @ (np.linalg.pinv(x.T @ x) @ x.T).T
    z = np.where(present, y, 0)

    def solved(w: np.ndarray) -> np.ndarray:
        return (np.linalg.pinv(np.einsum("ms,si,sj->mij", w, x, x), hermitian=True) @ np.einsum("ms,si->mi", w * z, x)[:, :, None])[:, :, 0]

    beta = solved(present.astype(float))
    for _ in range(steps if robust else 0):
        far = np.where(present, np.abs(z - beta @ x.T), np.nan)
        with np.errstate(all="ignore"):
            far = far / (bend * np.nanmedian(far, axis=1, keepdims=True) / 0.6745)
        before, beta = beta, solved(present / np.maximum(np.nan_to_num(far, nan=0.0, posinf=1e12), 1.0))
        if np.abs(beta - before).max(initial=0) < 1e-10:
            break
    if missing == "propagate":
        beta[~present.all(axis=1)] = np.nan
    return beta


def batch_corrected(packed: DataFrame, pheno: pd.DataFrame, batch: str, covariates: list[str] | None = None, robust: bool = False, missing: str = "propagate") -> DataFrame:
    """Packed values without the batch's fitted effect; ``pheno`` is in the order of the values.

    For the arguments see :func:`batch_coefficients`. A weight for each probe would scale all of its equation, and
    so not change its coefficients; there is no argument for one. A single batch changes nothing.
    """
    if pheno[batch].nunique() < 2:
        return packed
    x, of_batch = batch_design(pheno, batch, covariates)

    def run(batches):
        for b in batches:
            y = flat(b.column(1), len(x))
            yield pa.record_batch([b.column(0), nested(y - batch_coefficients(y, x, robust, missing)[:, of_batch] @ x[:, of_batch].T)], names=["probe_id", "values"])

    return packed.select("probe_id", "values").mapInArrow(run, "probe_id string, values array<double>")


def batch_diagnostics(packed: DataFrame, pheno: pd.DataFrame, batch: str, covariates: list[str] | None = None, robust: bool = False, missing: str = "propagate") -> DataFrame:
    """``probe_id, effects, residuals``: the coefficients of all of the design's columns, and what they leave."""
    x, _ = batch_design(pheno, batch, covariates)

    def run(batches):
        for b in batches:
            y = flat(b.column(1), len(x))
            beta = batch_coefficients(y, x, robust, missing)
            yield pa.record_batch([b.column(0), nested(beta), nested(y - beta @ x.T)], names=["probe_id", "effects", "residuals"])

    return packed.select("probe_id", "values").mapInArrow(run, "probe_id string, effects array<double>, residuals array<double>")


def batch_variance(packed: DataFrame, pheno: pd.DataFrame, batch: str, covariates: list[str] | None = None) -> DataFrame:
    """``probe_id`` and, for each column of the design, the mean square of its fitted term over the samples."""
    x, _ = batch_design(pheno, batch, covariates)
    beta = np.linalg.pinv(x.T @ x) @ x.T
    square = (x * x).mean(axis=0)
    names = ["intercept", *[f"term_{i}" for i in range(1, x.shape[1])]]
    dot = lambda row: F.aggregate(F.zip_with("values", F.array(*map(F.lit, row.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return packed.select("probe_id", *[(F.pow(dot(beta[i]), F.lit(2.0)) * float(square[i])).alias(n) for i, n in enumerate(names)])


def batch_standardized(cells: DataFrame, batches: DataFrame, recentre: bool = False) -> DataFrame:
    """Cells standardised within each batch and brought to the probe's overall spread (location and scale).

    ``(x - mean_b) / sd_b * sd``, with a spread of 0 (or of one cell) taken as 1; the mean is added back only with ``recentre``.
    """
    rows = cells.join(F.broadcast(batches.select("sample_id", "batch")), "sample_id")
    own = rows.groupBy("probe_id", "batch").agg(F.avg("value").alias("mean_b"), F.stddev_samp("value").alias("sd_b"))
    all_ = rows.groupBy("probe_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    sd_b = F.when(F.coalesce("sd_b", F.lit(0.0)) > 0, F.col("sd_b")).otherwise(1.0)
    value = (F.col("value") - F.col("mean_b")) / sd_b * F.coalesce("sd", F.lit(1.0))
    return rows.join(own, ["probe_id", "batch"]).join(all_, "probe_id").select(
        "probe_id", "sample_id", (value + F.col("mean") if recentre else value).alias("value"))


def _standardised(y: np.ndarray, x: np.ndarray, batches: int) -> tuple[np.ndarray, ...]:
    """Rows without their mean and covariates, by their pooled spread: values, what was taken off, spread, and whether a row can be (it
    is whole and varies within batches). The first ``batches`` columns of ``x`` are the batches'."""
    beta = y @ (np.linalg.pinv(x.T @ x) @ x.T).T
    share = x[:, :batches].mean(axis=0)
    mean = (beta[:, :batches] @ share)[:, None] + beta[:, batches:] @ x[:, batches:].T
    spread = np.sqrt(((y - beta @ x.T) ** 2).mean(axis=1))
    with np.errstate(all="ignore"):
        ok = spread > 1e-9
        return (y - mean) / np.where(ok, spread, 1)[:, None], mean, spread, ok


def combat_parametric(packed: DataFrame, pheno: pd.DataFrame, batch: str, covariates: list[str] | None = None, tolerance: float = 1e-12, steps: int = 500) -> DataFrame:
    """Packed values with batch effects shrunk to their distribution over probes (parametric empirical Bayes; Johnson, Li and Rabinovic, 2007).

    The effects of location and scale of each probe and batch are shrunk to a normal and an inverse gamma prior per batch,
    whose moments are one row; each probe is then solved on its own. Covariates' effects stay. Rows with a missing cell become missing, rows that don't
    vary within batches stay as they are, and every batch needs two samples.
    """
    labels = sorted(pheno[batch].unique())
    if len(labels) < 2:
        return packed
    of = [np.flatnonzero((pheno[batch] == b).to_numpy()) for b in labels]
    if min(map(len, of)) < 2:
        raise ValueError("a batch of one sample has no spread")
    terms = batch_design(pheno.assign(_one=0), "_one", covariates)[0][:, 1:] if covariates else np.zeros((len(pheno), 0))
    x = np.column_stack([*[(pheno[batch] == b).to_numpy(float) for b in labels], terms])
    k = len(labels)

    def effects(batches):
        for b in batches:
            z, _, _, ok = _standardised(flat(b.column(0), len(x)), x, k)
            g = np.stack([z[:, i].mean(axis=1) for i in of], axis=1)[ok]
            d = np.stack([z[:, i].var(axis=1, ddof=1) for i in of], axis=1)[ok]
            yield pa.record_batch([nested(g), nested(d)], names=["g", "d"])

    seen = packed.select("values").mapInArrow(effects, "g array<double>, d array<double>")
    moments = seen.agg(*[f(F.col(c)[i]).alias(f"{c}{n}{i}") for i in range(k) for c in "gd" for n, f in (("m", F.avg), ("v", F.var_samp))]).first().asDict()
    if any(v is None or not v > 0 for c, v in moments.items() if c[1] == "v"):
        raise ValueError("the batches' effects don't vary over probes")
    priors = [tuple(moments[f"{c}{n}{i}"] for c in "gd" for n in "mv") for i in range(k)]

    def run(batches):
        for b in batches:
            y = flat(b.column(1), len(x))
            z, mean, spread, ok = _standardised(y, x, k)
            out = z.copy()
            for i, (g0, t2, m, v) in zip(of, priors):
                a, c, n = 2 + m * m / v, m + m**3 / v, i.size
                hat, var = z[:, i].mean(axis=1), z[:, i].var(axis=1, ddof=1)
                g, d = hat, var
                for _ in range(steps):
                    before = g, d
                    g = (t2 * n * hat + d * g0) / (t2 * n + d)
                    d = (((n - 1) * var + n * (hat - g) ** 2) / 2 + c) / (n / 2 + a - 1)
                    if max(np.nanmax(np.abs(g - before[0]), initial=0), np.nanmax(np.abs(d - before[1]), initial=0)) < tolerance:
                        break
                out[:, i] = (z[:, i] - g[:, None]) / np.sqrt(d)[:, None]
            fixed = np.where(ok[:, None], out * spread[:, None] + mean, np.where(np.isnan(spread)[:, None], np.nan, y))
            yield pa.record_batch([b.column(0), nested(fixed)], names=["probe_id", "values"])

    return packed.select("probe_id", "values").mapInArrow(run, "probe_id string, values array<double>")


def combat(study: Study, batch: str, recentre: bool = False, method: str = "location-scale", covariates: list[str] | None = None) -> Study:
    """Batch correction of M-values, back in the study's own kind: by location and scale of each batch, or "parametric" (see
    :func:`combat_parametric`), which alone keeps covariates' effects."""
    if method not in ("location-scale", "parametric"):
        raise ValueError(f"unknown method {method!r}")
    kind = study.meta.get("matrix_type", "beta")
    m = convert(study, "M")
    if method == "parametric":
        pheno = study.pheno.orderBy("sample_id").toPandas()  # samples are few
        for c in covariates or []:
            if c not in pheno.columns:
                raise KeyError(c)
        samples = pheno["sample_id"].tolist()
        cells = unpack(combat_parametric(pack(m.cells, samples), pheno, batch, covariates), samples)
    elif covariates:
        raise ValueError("covariates need the parametric method")
    else:
        cells = batch_standardized(m.cells, study.pheno.select("sample_id", F.col(batch).alias("batch")), recentre)
    return convert(m.step(cells, batch_corrected=True, batch_method=method), kind)
