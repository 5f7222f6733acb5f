"""The data model: a matrix of cells with sample and probe tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.expressions import null_if_nan

DEFAULT_META = {"matrix_type": "beta", "normalized": False, "batch_corrected": False, "qc": {}}


@dataclass(frozen=True)
class Study:
    """Cells (``probe_id, sample_id, value``), samples (``sample_id`` and more), probes (``probe_id`` and more) and notes.

    Immutable: each step gives a new study.  Absent cells and null ones are missing.
    """

    cells: DataFrame
    pheno: DataFrame
    ann: DataFrame | None = None
    meta: dict = field(default_factory=lambda: dict(DEFAULT_META))

    def step(self, cells: DataFrame | None = None, **notes) -> Study:
        """The study after a step, with notes on it."""
        return replace(self, cells=self.cells if cells is None else cells, meta=self.meta | notes)

    def noted(self, **qc) -> Study:
        return replace(self, meta=self.meta | {"qc": self.meta.get("qc", {}) | qc})

    def samples(self) -> list[str]:
        """The samples' ids in order; a study has few samples and many probes."""
        return [r.sample_id for r in self.pheno.select("sample_id").orderBy("sample_id").collect()]

    def validated(self) -> Study:
        """Itself, if every sample is in ``pheno`` and every probe in ``ann``; else a KeyError with the first few that aren't."""
        for name, key, other in (("pheno", "sample_id", self.pheno), ("ann", "probe_id", self.ann)):
            if other is not None:
                lost = unknown(self.cells, other, key)
                if lost:
                    raise KeyError(f"not in {name}: {lost}")
        return self


def unknown(cells: DataFrame, other: DataFrame, key: str, show: int = 5) -> list[str]:
    """The first few keys of the cells that another table lacks."""
    return [r[0] for r in cells.select(key).distinct().join(other.select(key), key, "left_anti").orderBy(key).limit(show).collect()]


def cells_from_wide(wide: DataFrame, id_column: str) -> DataFrame:
    """Cells of a table with one column per sample; what isn't a number becomes null."""
    others = [c for c in wide.columns if c != id_column]
    cast = wide.select(F.col(f"`{id_column}`").cast("string").alias("probe_id"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in others])
    return cast.unpivot("probe_id", others, "sample_id", "value").withColumn("value", null_if_nan("value"))


def wide_from_cells(cells: DataFrame, samples: list[str]) -> DataFrame:
    """One column per sample; the samples are given, so that no extra job is needed."""
    return cells.groupBy("probe_id").pivot("sample_id", samples).agg(F.first("value"))


def pack(cells: DataFrame, samples: list[str]) -> DataFrame:
    """``probe_id, values``: an array in the order of ``samples``, with null for a missing cell."""
    order = F.array(*map(F.lit, samples))
    by = F.map_from_entries(F.collect_list(F.struct("sample_id", "value")))
    return cells.where(F.col("sample_id").isin(samples)).groupBy("probe_id").agg(by.alias("by")).select(
        "probe_id", F.transform(order, lambda s: F.col("by")[s]).alias("values"))


def flat(values: pa.ListArray, n: int) -> np.ndarray:
    """A batch of packed values as a matrix of ``n`` columns, with NaN for a missing cell."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def nested(y: np.ndarray) -> pa.ListArray:
    """A matrix as packed values, with null for NaN."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(y, float).ravel(), from_pandas=True))


def unpack(packed: DataFrame, samples: list[str]) -> DataFrame:
    """Cells of a packed matrix."""
    return packed.select("probe_id", F.posexplode("values").alias("i", "value")).select(
        "probe_id", F.get(F.array(*map(F.lit, samples)), "i").alias("sample_id"), "value")
