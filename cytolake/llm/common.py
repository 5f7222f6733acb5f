"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by
all executors on a cluster) as Parquet, so that a lost executor costs a re-read and
not a recomputation.  Only where that setting is absent in a local session, as in unit
tests, a folder is chosen here; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class ``[\x20\x09-\x0D]``.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Rows of a hand-over to Python; long texts make batches large, so it is small.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_cytolake_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark._cytolake_dir = "file://" + tempfile.mkdtemp(prefix="cytolake-")
    return own


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len({c.lower() for c in df.columns}) < len(df.columns):  # names that a table can't have: number them
        return staged(numbered(df)[0], name).toDF(*df.columns)
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by :func:`staged` that nothing reads any more."""
    root = shared_dir(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Extra columns go, also those whose names differ only in case
    or occur twice (the first of exactly that name is taken)."""
    plain, at = numbered(df)
    return plain.select(*[(F.col(at[c]) if c in at else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with the columns ``c0, c1, ...``, which clash with no other, and the new name of each (of the first
    that has exactly that name)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(reversed(list(zip(df.columns, names))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of every document."""
    return columns(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` whose input comes in small batches, so that memory holds few long texts."""

    def small(batches):
        def cut():
            for b in batches:
                for i in range(0, b.num_rows, rows):
                    yield b.slice(i, rows)

        yield from fn(cut())

    return df.mapInArrow(small, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _split(ddl: str) -> list[str]:
    """The parts of a DDL list at its commas outside angle brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    if name.startswith("struct<"):
        return pa.struct([(f.split(":", 1)[0].strip(), _arrow_type(f.split(":", 1)[1].strip())) for f in _split(name[7:-1])])
    return _ARROW[name]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; needs no session, so that workers can call it."""
    return pa.schema([(f.split(" ", 1)[0], _arrow_type(f.split(" ", 1)[1].strip())) for f in _split(ddl)])


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id) -> bool:
    """Whether a document's labels are kept from training: crc32 of its id as text, mod 4, is 2."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out_column(name: str = "doc_id"):
    """The same as a column."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixer (splitmix64's finaliser), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
