"""Quality control and filters on cells. Each is one or two aggregations and a semi or anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators.model import Study
from cytolake.operators.ranks import quantile


def sample_missingness(cells: DataFrame, n_probes: int | None = None) -> DataFrame:
    """``sample_id, n_missing, n_present, missing_fraction``; ``n_probes`` counts absent cells as missing too."""
    by = cells.groupBy("sample_id").agg(F.count("value").alias("n_present"), F.count("*").alias("n"))
    total = F.col("n") if n_probes is None else F.lit(n_probes)
    return by.select("sample_id", (total - F.col("n_present")).alias("n_missing"), "n_present", ((total - F.col("n_present")) / total).alias("missing_fraction"))


def probe_missingness(cells: DataFrame, n_samples: int | None = None) -> DataFrame:
    """The same per probe."""
    by = cells.groupBy("probe_id").agg(F.count("value").alias("n_present"), F.count("*").alias("n"))
    total = F.col("n") if n_samples is None else F.lit(n_samples)
    return by.select("probe_id", (total - F.col("n_present")).alias("n_missing"), "n_present", ((total - F.col("n_present")) / total).alias("missing_fraction"))


def qc_samples(study: Study, max_missing_fraction: float = 0.05, min_present: int | None = None, remove: bool = True) -> Study:
    """Drop (or only note) samples with more than a fraction of missing cells, or fewer present than ``min_present``."""
    n_probes = study.cells.select("probe_id").distinct().count()
    rates = sample_missingness(study.cells, n_probes)
    bad = F.col("missing_fraction") > max_missing_fraction
    if min_present is not None:
        bad = bad | (F.col("n_present") < min_present)
    flagged = [r.sample_id for r in rates.where(bad).select("sample_id").orderBy("sample_id").collect()]  # of the samples, which are few
    out = study.noted(flagged_samples=flagged)
    if not remove or not flagged:
        return out
    keep = ~F.col("sample_id").isin(flagged)
    return Study(study.cells.where(keep), study.pheno.where(keep), study.ann, out.meta)


def qc_probes(study: Study, max_missing_fraction: float = 0.10, drop_sex: bool = True, chromosome: str = "chromosome", n_samples: int | None = None) -> Study:
    """Drop probes with more than a fraction of missing cells, and those on a sex chromosome (with or without ``chr``)."""
    n = study.pheno.count() if n_samples is None else n_samples
    bad = probe_missingness(study.cells, n).where(F.col("missing_fraction") > max_missing_fraction).select("probe_id")
    if drop_sex and study.ann is not None and chromosome in study.ann.columns:
        sex = F.regexp_replace(F.upper(F.trim(chromosome)), "^CHR", "").isin("X", "Y")
        bad = bad.unionByName(study.ann.where(sex).select("probe_id")).distinct()
    ann = None if study.ann is None else study.ann.join(bad, "probe_id", "left_anti")
    return Study(study.cells.join(bad, "probe_id", "left_anti"), study.pheno, ann, study.meta)


def with_groups(cells: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """Cells with their sample's group; ``groups`` is a small table of samples."""
    return cells.join(F.broadcast(groups.select("sample_id", F.col(group).alias("group"))), "sample_id")


def filter_missingness(cells: DataFrame, n_samples: int, max_missing_rate: float = 0.2, min_per_group: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Cells of probes with at most a rate of missing cells and, if asked, ``min_per_group`` present in every group."""
    if not 0 <= max_missing_rate <= 1:
        raise ValueError(f"a rate between 0 and 1 is needed, not {max_missing_rate}")
    keep = cells.groupBy("probe_id").agg(F.count("value").alias("n")).where(n_samples - F.col("n") <= max_missing_rate * n_samples)
    if min_per_group is not None:
        if groups is None:
            raise ValueError("min_per_group needs groups")
        levels = groups.select("group").distinct().count()
        full = with_groups(cells, groups).groupBy("probe_id", "group").agg(F.count("value").alias("n")).where(F.col("n") >= min_per_group)
        keep = keep.join(full.groupBy("probe_id").agg(F.count("*").alias("full")).where(F.col("full") == levels), "probe_id")
    return cells.join(keep.select("probe_id"), "probe_id", "left_semi")


def filter_min_per_group(cells: DataFrame, groups: DataFrame, min_per_group: int = 5) -> DataFrame:
    """Cells of probes with at least so many present cells in some group."""
    keep = with_groups(cells, groups).groupBy("probe_id", "group").agg(F.count("value").alias("n")).where(F.col("n") >= min_per_group)
    return cells.join(keep.select("probe_id").distinct(), "probe_id", "left_semi")


def probe_variance(cells: DataFrame) -> DataFrame:
    """``probe_id, variance``: the sample variance of each probe's present cells."""
    return cells.groupBy("probe_id").agg(F.var_samp("value").alias("variance"))


def filter_low_variance(cells: DataFrame, min_percentile: float = 10.0) -> DataFrame:
    """Cells of probes whose variance is at least that percentile of all (or equal to it but for rounding); the threshold is one row."""
    variance = probe_variance(cells).where(F.col("variance").isNotNull() & ~F.isnan("variance"))
    least = quantile(variance, "variance", min_percentile / 100, out="least")
    keep = variance.crossJoin(F.broadcast(least)).where("variance >= least * (1 - 1e-9D)").select("probe_id")  # one row
    return cells.join(keep, "probe_id", "left_semi")


def impute(cells: DataFrame, method: str = "mean") -> DataFrame:
    """Missing cells by their probe's mean or median; probes without any present cell stay missing."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method!r}; for nearest neighbours see cytolake.operators.neighbours")
    fill = cells.groupBy("probe_id").agg((F.avg("value") if method == "mean" else F.median("value")).alias("fill"))
    return cells.join(fill, "probe_id").select("probe_id", "sample_id", F.coalesce("value", "fill").alias("value"))
