"""Writers of results and studies."""

from __future__ import annotations

import json
import math
import os
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators.model import Study

CORE = ("logFC", "t", "pval", "padj", "F", "df1", "df2")


def result_columns(res: DataFrame, include_all: bool = False) -> DataFrame:
    """The core columns of a results table (id, effect, tests and group means), or all."""
    if include_all:
        return res
    return res.select(*[c for c in res.columns if c == "probe_id" or c in CORE or c.startswith(("mean_", "meanM_", "meanB_"))])


def _mode(path: str, overwrite: bool) -> str:
    if not overwrite and "://" not in path and os.path.exists(path):
        raise FileExistsError(path)
    return "overwrite" if overwrite else "errorifexists"


def export_results(res: DataFrame, path: str, format: str = "csv", include_all: bool = False, overwrite: bool = True) -> None:
    """Write a results table as csv, tsv, parquet or excel; another format raises a RuntimeError."""
    out = result_columns(res, include_all)
    mode = _mode(path, overwrite)
    if format in ("csv", "tsv"):
        out.write.mode(mode).csv(path, header=True, sep="," if format == "csv" else "\t")
    elif format == "parquet":
        out.write.mode(mode).parquet(path)
    elif format in ("excel", "xlsx"):
        out.toPandas().to_excel(path, index=False)
    else:
        raise RuntimeError(f"unsupported format: {format!r}")


def save_study(study: Study, path: str, format: str = "parquet", compression: str = "zstd", overwrite: bool = True) -> None:
    """Write a study's tables and notes under a folder, as parquet, csv or tsv; or to one file of the driver's, as pickle or
    HDF5 (which needs the package tables), for a study that fits there."""
    mode = _mode(path, overwrite)
    spark = study.cells.sparkSession
    tables = {name: df for name, df in (("cells", study.cells), ("pheno", study.pheno), ("ann", study.ann)) if df is not None}
    if format == "pickle":
        with open(path, "wb") as f:
            pickle.dump({name: df.toPandas() for name, df in tables.items()} | {"meta": study.meta}, f)
        return
    if format == "hdf5":
        import tables as _  # noqa: F401  (a clear error before anything is written)

        for i, (name, df) in enumerate(tables.items()):
            df.toPandas().to_hdf(path, key=name, mode="w" if i == 0 else "a", complib="blosc")
        pd.Series([json.dumps(study.meta)]).to_hdf(path, key="meta", mode="a")
        return
    for name, df in tables.items():
        if format == "parquet":
            df.write.mode(mode).option("compression", compression).parquet(f"{path}/{name}")
        elif format in ("csv", "tsv"):
            df.write.mode(mode).csv(f"{path}/{name}", header=True, sep="," if format == "csv" else "\t")
        else:
            raise ValueError(f"unsupported format: {format!r}")
    note = json.dumps({"meta": study.meta, "format": format, "schemas": {name: df.schema.jsonValue() for name, df in tables.items()}})
    spark.createDataFrame([(note,)], "value string").write.mode(mode).text(f"{path}/meta")


def sample_sheet_json(sheet: DataFrame) -> DataFrame:
    """``sample_id, json``: each sample's record as JSON, as the HDF5 layout keeps it."""
    return sheet.select("sample_id", F.to_json(F.struct(*[c for c in sheet.columns if c != "sample_id"])).alias("json"))


def row_blocks(df: DataFrame, columns: list[str], rows: int = 10_000):
    """The ids and the numbers (NaN for null) of a wide table, some rows at a time, in the driver."""
    ids, block = [], []
    for r in df.select("probe_id", *[f"`{c}`" for c in columns]).toLocalIterator():
        ids.append(r[0])
        block.append([math.nan if v is None else float(v) for v in r[1:]])
        if len(ids) == rows:
            yield ids, np.array(block)
            ids, block = [], []
    if ids:
        yield ids, np.array(block)


def export_hdf5(beta: DataFrame, mvals: DataFrame, sheet: DataFrame, path: str, compress: bool = True) -> str:
    """Groups ``/beta``, ``/mvals`` and ``/samples`` of one HDF5 file, written on the driver by blocks of rows; needs h5py."""
    import h5py

    keep = {"compression": "gzip"} if compress else {}
    with h5py.File(path, "w") as f:
        for name, df in (("beta", beta), ("mvals", mvals)):
            group, samples = f.create_group(name), [c for c in df.columns if c != "probe_id"]
            values = group.create_dataset("values", shape=(0, len(samples)), maxshape=(None, len(samples)), chunks=True, dtype="f8", **keep)
            probes = group.create_dataset("probes", shape=(0,), maxshape=(None,), chunks=True, dtype=h5py.string_dtype())
            for ids, block in row_blocks(df, samples):
                at = len(probes)
                for data, new in ((values, block), (probes, ids)):
                    data.resize(at + len(ids), axis=0)
                    data[at:] = new
            group.create_dataset("samples", data=[str(x).encode() for x in samples])
        group = f.create_group("samples")
        for r in sample_sheet_json(sheet).collect():
            group.attrs[r.sample_id] = r.json
    return path
