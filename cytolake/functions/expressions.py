"""Scalar column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beta values are kept this far from 0 and 1 before a logarithm.
EDGE = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x) -> Column:
    """A double with NaN as null."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x), x)


def beta_to_m(x) -> Column:
    """M-value of a beta value: ``log2(b / (1 - b))`` with ``b`` kept off 0 and 1. Null stays null."""
    x = _c(x)
    b = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(EDGE)), F.lit(1 - EDGE)))
    return F.log2(b / (F.lit(1.0) - b))


def m_to_beta(x) -> Column:
    """Beta value of an M-value."""
    p = F.pow(F.lit(2.0), _c(x))
    return p / (F.lit(1.0) + p)


def clean_chromosome(x) -> Column:
    """A chromosome's name as ``chr...`` in lower case, but ``chrX`` and ``chrY``."""
    bare = F.regexp_replace(F.trim(_c(x)), "(?i)^chr", "")
    return F.when(F.upper(bare).isin("X", "Y"), F.concat(F.lit("chr"), F.upper(bare))).otherwise(F.concat(F.lit("chr"), F.lower(bare)))


def quantile(values: Column, q: float) -> Column:
    """The linear quantile of an array's non-null elements."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    h = (F.size(s) - 1) * F.lit(float(q))
    low = F.floor(h).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (h - low) * (b - a)


def winsorized(values: Column, lower: float = 0.05, upper: float = 0.95) -> Column:
    """An array with its elements kept between two of its quantiles; nulls stay."""
    if not 0 <= lower < upper <= 1:
        raise ValueError(f"quantiles must satisfy 0 <= lower < upper <= 1, got {lower} and {upper}")
    lo, hi = quantile(values, lower), quantile(values, upper)
    return F.transform(values, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi)))
