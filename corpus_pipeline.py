"""The corpus pipeline: five stages over ``documents``, each calling one operator.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.
All but the last return the columns that they were given; a stage's decisions take
effect in what it returns.  Rows with a null doc_id pass through the stages like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import numbered, staged, table
from cytolake.llm.exact_dedup import without_copies
from cytolake.llm.labelled import labels_of
from cytolake.llm.near_dedup import one_of_each
from cytolake.llm.packing import pack
from cytolake.llm.quality import keep_quality, train
from cytolake.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(docs, train(docs, labels_of(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then the smallest doc_id."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near duplicates (five words, 0.8)."""
    return one_of_each(docs, words=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that have occurred before."""
    out, at = numbered(without_repeats(docs))
    if "n_chars" in at:
        n = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.select(*[n.alias(c) if c == at["n_chars"] else c for c in out.columns])
    return out.toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 4096."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packing)]

#: SQL can't express the classifier or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; what each returns is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
