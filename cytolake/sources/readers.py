"""Readers by file kind, and of whole studies."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.functions.expressions import null_if_nan
from cytolake.operators.model import DEFAULT_META, Study, cells_from_wide, unknown


def _small(spark: SparkSession, frame: pd.DataFrame, index_col) -> DataFrame:
    """A file kind that only the driver can read."""
    if isinstance(index_col, int) and not 0 <= index_col < len(frame.columns):
        raise IndexError(f"no column {index_col} among {len(frame.columns)}")
    return spark.createDataFrame(frame)


def read_table(spark: SparkSession, path: str, index_col: int | str = 0, trusted: bool = False) -> DataFrame:
    """A table by its file's ending; the id column named or counted by ``index_col`` comes first.

    Text and Parquet files are read by Spark, in parallel. Excel, Feather, HDF5 and (only if ``trusted``) pickle
    files are read on the driver, as their formats can't be split; a missing library gives an ImportError.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if kind in (".csv", ".tsv", ".txt"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == ".csv" else "\t")
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind in (".xlsx", ".xls"):
        df = _small(spark, pd.read_excel(path), index_col)
    elif kind == ".feather":
        import pyarrow.feather

        df = _small(spark, pyarrow.feather.read_table(path).to_pandas(), index_col)
    elif kind in (".pkl", ".pickle"):
        if not trusted:
            raise ValueError("a pickle file can run any code; pass trusted=True if you trust it")
        df = _small(spark, pd.read_pickle(path), index_col)
    elif kind in (".h5", ".hdf5"):
        with pd.HDFStore(path, "r") as store:
            keys = store.keys()
            if len(keys) != 1:
                raise ValueError(f"the file has {len(keys)} tables: {keys}")
            df = _small(spark, store[keys[0]].reset_index(), index_col)
    else:
        raise ValueError(f"unsupported file kind: {kind!r}")
    name = df.columns[index_col] if isinstance(index_col, int) else index_col
    return df.select(F.col(f"`{name}`").cast("string").alias(name), *[f"`{c}`" for c in df.columns if c != name])


def load_study(spark: SparkSession, matrix: str | DataFrame, pheno: str | DataFrame | None = None, ann: str | DataFrame | None = None,
               index_col_probe: int | str = 0, index_col_sample: int | str = 0) -> Study:
    """A study from paths or tables.

    Cells that aren't numbers become missing and are counted in ``meta``. Without ``pheno`` the samples are the
    matrix's columns; samples that it lacks raise a KeyError.
    """

    def of(source, index_col):
        if isinstance(source, str):
            return read_table(spark, source, index_col)
        if not isinstance(source, DataFrame):
            raise TypeError(f"a path or a DataFrame is needed, not {type(source).__name__}")
        name = source.columns[index_col] if isinstance(index_col, int) else index_col
        return source.select(F.col(f"`{name}`").cast("string").alias(name), *[f"`{c}`" for c in source.columns if c != name])

    wide = of(matrix, index_col_probe)
    samples = wide.columns[1:]
    cells = cells_from_wide(wide, wide.columns[0])
    given = F.array(*[F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull() for c in samples]) if samples else F.array()
    coerced = wide.agg(F.sum(F.size(F.filter(given, lambda x: x)))).first()[0] or 0
    if pheno is None:
        people = spark.createDataFrame([(s,) for s in samples], "sample_id string")
    else:
        people = of(pheno, index_col_sample)
        people = people.withColumnRenamed(people.columns[0], "sample_id")
        lost = unknown(cells, people, "sample_id")
        if lost:
            raise KeyError(f"samples without phenotype: {lost}")
        people = people.where(F.col("sample_id").isin(samples))
    probes = None
    if ann is not None:
        probes = of(ann, index_col_probe)
        probes = probes.withColumnRenamed(probes.columns[0], "probe_id")
    return Study(cells, people, probes, DEFAULT_META | {"n_coerced": int(coerced)}).validated()


def load_saved(spark: SparkSession, path: str, trusted: bool = False) -> Study:
    """A study written by :func:`cytolake.sources.writers.save_study`: a folder, or a file (``.pkl`` or ``.pickle``, which must
    be ``trusted``, or HDF5)."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".pkl", ".pickle"):
        if not trusted:
            raise ValueError("a pickle file can run any code; pass trusted=True if you trust it")
        got = pd.read_pickle(path)
    elif suffix in (".h5", ".hdf5"):
        with pd.HDFStore(path, "r") as store:
            got = {key.strip("/"): store[key] for key in store.keys()}
        got["meta"] = json.loads(got["meta"].iloc[0])
    else:
        note = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
        read, tables = spark.read, {}
        for name, schema in note["schemas"].items():
            schema = StructType.fromJson(schema)
            if note["format"] == "parquet":
                tables[name] = read.schema(schema).parquet(f"{path}/{name}")
            else:
                tables[name] = read.csv(f"{path}/{name}", header=True, schema=schema, sep="," if note["format"] == "csv" else "\t")
        return Study(tables["cells"], tables["pheno"], tables.get("ann"), note["meta"])
    tables = {name: spark.createDataFrame(got[name]) for name in ("cells", "pheno", "ann") if name in got}
    return Study(tables["cells"].withColumn("value", null_if_nan("value")), tables["pheno"], tables.get("ann"), got["meta"])
