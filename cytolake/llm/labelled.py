"""Labelled documents for training: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import columns, held_out_column, table


def learnt_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of every labelled document that isn't held out.

    Rows without an id or label are left out; a document with several labels has the largest.
    """
    rows = columns(labels, doc_id="bigint", **{label: "int"}).where(F.col(label).isin(0, 1) & ~held_out_column())
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("label"))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, text, label`` of every row of a labelled document that isn't held out. Neither side has a size bound: nothing is broadcast."""
    rows = columns(docs, doc_id="bigint", text="string").where(~held_out_column())
    return rows.hint("merge").join(learnt_labels(labels, label).hint("merge"), "doc_id")


def training_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, label`` of at most ``rows`` labelled documents that aren't held out, chosen by a hash of their id."""
    return learnt_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_documents(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of the training sample; its at most ``rows`` ids and labels are what is broadcast."""
    spark = docs.sparkSession
    chosen = [(r.doc_id, r.label) for r in training_labels(labels, label, rows).collect()]
    small = spark.createDataFrame(chosen, "doc_id bigint, label int")
    return columns(docs, doc_id="bigint", text="string").join(F.broadcast(small), "doc_id")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of labels."""
    return table(spark, sf_dir, "labels")
