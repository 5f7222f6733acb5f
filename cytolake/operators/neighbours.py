"""Imputation from nearest neighbours.

Probes' neighbours are sought in blocks of a fixed size: every block of incomplete probes
is compared with every block of all, one pair of blocks at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators.model import flat, nested


#: Probes in a block.
BLOCK_ROWS = 2000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances over the features that both rows have, scaled up to all features; infinite without any."""
    px, py = ~np.isnan(x), ~np.isnan(y)
    fx, fy = np.where(px, x, 0), np.where(py, y, 0)
    common = px.astype(float) @ py.T
    square = (fx * fx) @ py.T + px @ (fy * fy).T - 2 * fx @ fy.T
    with np.errstate(all="ignore"):
        return np.sqrt(np.where(common > 0, np.maximum(square, 0) * x.shape[1] / common, np.inf))


def weighted(values: np.ndarray, far: np.ndarray) -> float:
    """Mean by inverse distance; neighbours at no distance take all the weight."""
    return float(values[far == 0].mean()) if (far == 0).any() else float((values / far).sum() / (1 / far).sum())


def impute_matrix(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's missing features from the ``k`` nearest rows that have them; else the feature's mean."""
    out, d = x.copy(), distances(x, x)
    np.fill_diagonal(d, np.inf)
    for i, j in zip(*np.nonzero(np.isnan(x))):
        donors = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(d[i]))
        if donors.size:
            near = donors[np.argsort(d[i, donors], kind="stable")[:k]]
            out[i, j] = weighted(x[near, j], d[i, near])
        elif (~np.isnan(x[:, j])).any():
            out[i, j] = np.nanmean(x[:, j])
    return out


def impute_samples(packed: DataFrame, n_samples: int, k: int = 5) -> DataFrame:
    """Missing cells from the ``k`` samples nearest over all probes.

    Distances between samples are sums over probes, added up in the cluster (``n_samples**2`` numbers); each
    probe is then filled on its own.
    """
    def sums(batches):
        total = np.zeros((2, n_samples, n_samples))
        for b in batches:
            x = flat(b.column(0), n_samples)
            p = ~np.isnan(x)
            z = np.where(p, x, 0)
            total[0] += p.T.astype(float) @ p
            total[1] += (z * z).T @ p + p.T @ (z * z) - 2 * z.T @ z
        yield pa.record_batch([pa.array(np.arange(n_samples * n_samples)), pa.array(total[0].ravel()), pa.array(total[1].ravel())], names=["i", "common", "square"])

    got = packed.select("values").mapInArrow(sums, "i long, common double, square double").groupBy("i").agg(F.sum("common").alias("common"), F.sum("square").alias("square")).toPandas()
    probes = packed.count()
    d = np.full(n_samples * n_samples, np.inf)
    ok = got["common"].to_numpy() > 0
    d[got["i"].to_numpy()[ok]] = np.sqrt(np.maximum(got["square"].to_numpy()[ok], 0) * probes / got["common"].to_numpy()[ok])
    d = d.reshape(n_samples, n_samples)
    np.fill_diagonal(d, np.inf)

    def fill(batches):
        for b in batches:
            x = flat(b.column(1), n_samples)
            y, present = x.copy(), ~np.isnan(x)
            for i, j in zip(*np.nonzero(~present)):  # missing cells alone
                donors = np.flatnonzero(present[i] & np.isfinite(d[j]))
                if donors.size:
                    near = donors[np.argsort(d[j, donors], kind="stable")[:k]]
                    y[i, j] = weighted(x[i, near], d[j, near])
            yield pa.record_batch([b.column(0), nested(y)], names=["probe_id", "values"])

    return packed.select("probe_id", "values").mapInArrow(fill, "probe_id string, values array<double>")


def impute_probes(packed: DataFrame, n_samples: int, k: int = 5, block_rows: int = BLOCK_ROWS, blocks: int | None = None) -> DataFrame:
    """Missing cells from the ``k`` nearest probes that have them; else the sample's mean.

    Only probes with a missing cell ask; each is compared with all probes, block by block, and of each block its
    ``k`` best donors for each missing cell go on. There are as many blocks as it takes for each to have about
    ``block_rows`` probes (or as many as ``blocks`` says), so that a task's matrices don't grow with the input; all probes are sent once for each block that asks.
    """
    missing = F.exists("values", lambda v: v.isNull())
    sizes = packed.agg(F.count("*").alias("n"), F.count_if(missing).alias("asks")).first()
    blocks, own = (blocks or max(1, -(-n // block_rows)) for n in (sizes.n, sizes.asks))
    rows = packed.select("probe_id", "values", F.pmod(F.xxhash64("probe_id"), F.lit(blocks)).alias("block"))
    asks = packed.where(missing).select("probe_id", "values", F.pmod(F.xxhash64("probe_id", F.lit(1)), F.lit(own)).alias("own"))
    # A stated query set (the incomplete probes) against all rows, in blocks.
    left = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("probe_id", "values", (F.col("block") * own + F.col("own")).alias("key"))
    right = rows.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(own - 1)))).select("probe_id", "values", (F.col("block") * own + F.col("own")).alias("key"))

    def matrix(f):
        return np.array([[np.nan if v is None else v for v in r] for r in f["values"]], float).reshape(-1, n_samples)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, out = matrix(a), matrix(b), []
        if len(a) and len(b):
            d = distances(x, y)
            d[a["probe_id"].to_numpy()[:, None] == b["probe_id"].to_numpy()[None, :]] = np.inf
            for i, j in zip(*np.nonzero(np.isnan(x))):
                donors = np.flatnonzero(~np.isnan(y[:, j]) & np.isfinite(d[i]))
                for m in donors[np.lexsort((b["probe_id"].to_numpy()[donors].astype(str), d[i, donors]))[:k]]:
                    out.append((a["probe_id"].iloc[i], int(j), float(d[i, m]), b["probe_id"].iloc[m], float(y[m, j])))
        return pd.DataFrame(out, columns=["probe_id", "i", "d", "donor", "v"])

    found = left.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(best, "probe_id string, i int, d double, donor string, v double")
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "donor", "v"))), 1, k)  # of at most blocks * k
    zero = lambda a: F.filter(a, lambda x: x["d"] == 0)
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.when(F.size(zero(F.col("n"))) > 0, add(zero(F.col("n")), lambda x: x["v"]) / F.size(zero(F.col("n")))).otherwise(
        add(F.col("n"), lambda x: x["v"] / x["d"]) / add(F.col("n"), lambda x: 1 / x["d"]))
    fills = found.groupBy("probe_id", "i").agg(near.alias("n")).select("probe_id", "i", mean.alias("fill"))
    cells = packed.select("probe_id", F.posexplode("values").alias("i", "value"))
    means = cells.groupBy("i").agg(F.avg("value").alias("mean"))
    full = cells.join(fills, ["probe_id", "i"], "left").join(F.broadcast(means), "i")
    return full.groupBy("probe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("value", "fill", "mean").alias("v")))), lambda x: x["v"]).alias("values"))
