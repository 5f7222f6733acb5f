"""Design matrices and contrasts; a study's samples are few, so these are small arrays on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_design(data: pd.DataFrame, categorical: list[str] | None = None, add_intercept: bool = True, drop_first: bool = True) -> pd.DataFrame:
    """``intercept``, the numeric columns, then a 0/1 column ``{column}_{level}`` for each level but the first, all floats.

    Without ``categorical``, text, category and boolean columns are.
    """
    if not isinstance(data, pd.DataFrame):
        raise TypeError(f"a table of covariates is needed, not {type(data).__name__}")
    if categorical is None:
        categorical = [c for c in data if not pd.api.types.is_numeric_dtype(data[c]) or pd.api.types.is_bool_dtype(data[c])]
    out = {"intercept": np.ones(len(data))} if add_intercept else {}
    out |= {c: data[c].to_numpy(float) for c in data if c not in categorical}
    for c in categorical:
        for level in sorted(data[c].dropna().unique())[1 if drop_first else 0:]:
            out[f"{c}_{level}"] = (data[c] == level).to_numpy(float)
    return pd.DataFrame(out, index=data.index)


def dummies(pheno: DataFrame, column: str, levels: list, drop_first: bool = True) -> DataFrame:
    """The same coding of one column as a DataFrame, for given levels."""
    return pheno.select("sample_id", F.lit(1.0).alias("intercept"), *[
        F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in sorted(levels)[1 if drop_first else 0:]])


def contrast_vector(design: pd.DataFrame, contrast) -> np.ndarray:
    """A contrast's coefficients: numbers, or for two columns the text ``"A-B"``.

    A ``ref-treat`` text asks for the second coefficient's negative, any other for itself. Wrong lengths, all zeros
    and contrasts that the design can't estimate raise a ValueError.
    """
    if isinstance(contrast, str):
        if design.shape[1] != 2 or contrast.count("-") != 1:
            raise ValueError(f"the text contrast {contrast!r} needs a design of two columns and one minus")
        a, _ = (s.strip().lower() for s in contrast.split("-"))
        return np.array([0.0, -1.0 if a in ("ref", "reference", "control") else 1.0])
    c = np.asarray(contrast, float).ravel()
    if c.size != design.shape[1]:
        raise ValueError(f"{c.size} numbers for {design.shape[1]} coefficients")
    if not c.any():
        raise ValueError("the contrast is all zeros")
    x = design.to_numpy(float)
    if not np.allclose(c @ np.linalg.pinv(x) @ x, c, atol=1e-8):
        raise ValueError("the design can't estimate this contrast")
    return c


def check_alignment(samples: list[str], design: pd.DataFrame, paired_ids: list | None = None, group_column: int = 1) -> None:
    """Raise unless samples are unique and as many as the design's rows, and each pair has one member in each group."""
    if len(samples) != len(design):
        raise ValueError(f"{len(samples)} samples but {len(design)} rows in the design")
    twice = sorted({s for s in samples if samples.count(s) > 1})
    if twice:
        raise KeyError(f"repeated samples: {twice[:5]}")
    if paired_ids is not None:
        if len(paired_ids) != len(samples):
            raise ValueError(f"{len(paired_ids)} pair ids for {len(samples)} samples")
        pairs = pd.DataFrame({"pair": list(paired_ids), "group": design.iloc[:, group_column].to_numpy()}).groupby("pair")["group"]
        if (pairs.size() != 2).any() or (pairs.nunique() != 2).any():
            raise ValueError("each pair id must occur twice, once in each group")


def pairs_report(pheno: DataFrame, pair: str, group: str) -> DataFrame:
    """``pair, n, n_groups`` of pair ids that don't occur exactly twice, once in each of two groups."""
    by = pheno.groupBy(F.col(pair).alias("pair")).agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"))
    return by.where((F.col("n") != 2) | (F.col("n_groups") != 2))


def matrix_bytes(n_probes: int, n_samples: int) -> int:
    """An estimate of what an analysis of a whole matrix in one place would take: four copies of its doubles.

    Here it only helps to choose a number of partitions; Spark spills, so nothing is refused.
    """
    return 4 * 8 * n_probes * n_samples
