"""Matrices and annotation derived from the star-schema tables, as DataFrames and as SQL.

Values are ratios of whole numbers, so that both engines give the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = [str(y) for y in range(1995, 2002)]
#: Group A: three years; batch: odd and even years.
GROUP_A = YEARS[:3]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value():
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    return F.least(F.greatest(cents / (F.count("*") * F.lit(10.0)), F.lit(0.0)), F.lit(1.0)).alias("value")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as probes, years of shipping as samples: beta values."""
    return read(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("cg"), F.col("l_partkey")).alias("probe_id"), F.year("l_shipdate").cast("string").alias("sample_id")).agg(_value())


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as probes, months of shipping as samples: many samples, some cells missing."""
    return read(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("cg"), F.col("l_suppkey")).alias("probe_id"), F.date_format("l_shipdate", "yyyy-MM").alias("sample_id")).agg(_value())


def pheno(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y, "A" if y in GROUP_A else "B", int(y) % 2, float(int(y) - 1990)) for y in YEARS], "sample_id string, group string, batch int, age double")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions as probes, vectors as samples, with the vector's label as ``group``."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"), "label")
    return e.select(F.concat(F.lit("d"), F.col("d")).alias("probe_id"), F.col("vec_id").cast("string").alias("sample_id"), F.col("v").cast("double").alias("value"), F.col("label").cast("string").alias("group"))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' brand numbers as chromosomes, keys as positions, names as genes, types as pathways."""
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("cg"), F.col("p_partkey")).alias("probe_id"), F.concat(F.lit("chr"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("chr"),
        (F.col("p_partkey") * 100).alias("pos"), F.col("p_name").alias("gene"), F.col("p_type").alias("pathway"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene around every part."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene_ord"), F.concat(F.lit("chr"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("chr"), (F.col("p_partkey") * 100 - 200).alias("start"),
                    (F.col("p_partkey") * 100 + 300).alias("end"), F.concat(F.lit("G"), F.col("p_partkey")).alias("gene_symbol"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sites: type as chromosome, second as position, value as effect, and a p-value from the id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("probe_id"), F.concat(F.lit("chr"), F.col("event_type")).alias("chr"), F.unix_timestamp("ts").alias("pos"),
                    F.round(F.col("value") * 1000).cast("bigint").alias("milli"), ((F.col("event_id") * 7919) % 1000 / F.lit(8000.0)).alias("padj"))


def results(spark: SparkSession, sf_dir: str, factor: int = 104729) -> DataFrame:
    """A results table of parts: effects and p-values from their keys and prices."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("cg"), k).alias("probe_id"), (((k * 31) % 401 - 200) / F.lit(100.0)).alias("logFC"), (((k * factor) % 10007 + 1) / F.lit(10008.0)).alias("pval"),
        F.least(((k * factor) % 10007 + 1) / F.lit(5004.0), F.lit(1.0)).alias("padj"), ((k % 97 + 1) / F.lit(50.0)).alias("s2"), ((k % 89 + 2) / F.lit(60.0)).alias("s2_post"), F.lit(4.0).alias("d0"))


# The same as SQL.
_VALUE = "least(greatest(sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / (count(*) * 10.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS value"
CELLS = f"cells AS (SELECT 'cg' || l_partkey AS probe_id, CAST(year(l_shipdate) AS VARCHAR) AS sample_id, {_VALUE} FROM lineitem GROUP BY 1, 2)"
MONTHLY = f"cells AS (SELECT 'cg' || l_suppkey AS probe_id, strftime(l_shipdate, '%Y-%m') AS sample_id, {_VALUE} FROM lineitem GROUP BY 1, 2)"
PHENO = "pheno AS (SELECT CAST(y AS VARCHAR) AS sample_id, CASE WHEN y <= 1997 THEN 'A' ELSE 'B' END AS grp, y % 2 AS batch FROM range(1995, 2002) r(y))"
EMBEDDING = "cells AS (SELECT 'd' || (i - 1) AS probe_id, CAST(vec_id AS VARCHAR) AS sample_id, CAST(embedding[i] AS DOUBLE) AS value, CAST(label AS VARCHAR) AS grp FROM embeddings, range(1, 65) r(i))"
ANNOTATION = "ann AS (SELECT 'cg' || p_partkey AS probe_id, 'chr' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS chr, p_partkey * 100 AS pos, p_name AS gene, p_type AS pathway FROM part)"
GENES = ("genes AS (SELECT p_partkey AS gene_ord, 'chr' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS chr, p_partkey * 100 - 200 AS s, p_partkey * 100 + 300 AS e, "
         "'G' || p_partkey AS gene_symbol, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)")
SITES = ("sites AS (SELECT CAST(event_id AS VARCHAR) AS probe_id, lower('chr' || event_type) AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS pos, CAST(round(value * 1000) AS BIGINT) AS milli, "
         "((event_id * 7919) % 1000)::DOUBLE / 8000.0::DOUBLE AS padj FROM events)")


def results_sql(name: str = "res", factor: int = 104729) -> str:
    return (f"{name} AS (SELECT 'cg' || p_partkey AS probe_id, ((p_partkey * 31) % 401 - 200)::DOUBLE / 100.0::DOUBLE AS logFC, ((p_partkey * {factor}) % 10007 + 1)::DOUBLE / 10008.0::DOUBLE AS pval, "
            f"least(((p_partkey * {factor}) % 10007 + 1)::DOUBLE / 5004.0::DOUBLE, 1.0::DOUBLE) AS padj, (p_partkey % 97 + 1)::DOUBLE / 50.0::DOUBLE AS s2, (p_partkey % 89 + 2)::DOUBLE / 60.0::DOUBLE AS s2_post, 4.0::DOUBLE AS d0 FROM part)")
