"""Cell composition by non-negative least squares.

The normal equations of a sample need only ``R'R`` (one small matrix) and ``R'b`` (one
number per cell type), which are sums over features: they are added up in the cluster
by a join and an aggregation, and the solver sees a few numbers per sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nnls(gram: np.ndarray, right: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """``w >= 0`` that minimises ``w'Gw/2 - r'w``, by Lawson and Hanson's active sets."""
    n = right.size
    w, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(30 * n + 30):
        slope = right - gram @ w
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if not slope[j] > tolerance * scale:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], right[passive], rcond=None)[0]
            if (z[passive] > 0).all():
                w = z
                break
            bad = passive & (z <= 0)
            step = (w[bad] / (w[bad] - z[bad])).min()
            w = w + step * (z - w)
            passive &= w > 1e-15
            w[~passive] = 0
    return w


def cell_composition(bulk: DataFrame, reference: DataFrame) -> DataFrame:
    """``sample_id, cell_type, proportion``: proportions sum to 1 (or are all 0) in each sample.

    ``bulk``: cells; ``reference``: ``probe_id, cell_type, value``. Features that both have are used; without any a
    ValueError is raised. Missing bulk cells are left out of their sample's sums.
    """
    types = [r.cell_type for r in reference.select("cell_type").distinct().orderBy("cell_type").collect()]
    profile = reference.groupBy("probe_id").agg(*[F.first(F.when(F.col("cell_type") == c, F.col("value")), ignorenulls=True).alias(f"_{i}") for i, c in enumerate(types)])
    both = bulk.where("value is not null").join(profile, "probe_id")
    k = len(types)
    sums = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"_{i}") * F.col("value")).alias(f"b_{i}") for i in range(k)]
    by = both.groupBy("sample_id").agg(*sums)
    if both.limit(1).count() == 0:
        raise ValueError("the bulk samples and the reference have no feature in common")

    def solve(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                w = nnls(g, np.array([r[f"b_{i}"] for i in range(k)]))
                total = w.sum()
                out += [(r["sample_id"], c, float(v / total) if total > 0 else 0.0) for c, v in zip(types, w)]
            yield pd.DataFrame(out, columns=["sample_id", "cell_type", "proportion"])

    return by.mapInPandas(solve, "sample_id string, cell_type string, proportion double")
