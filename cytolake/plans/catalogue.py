"""The queries of the analytics operators over the star-schema tables, and their SQL.

Each entry is a function of ``(spark, sf_dir)``; its SQL, where it can be written, runs in
DuckDB over the same tables.  Computed doubles are rounded on both sides, far from where
the engines' last digits differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions.expressions import beta_to_m, clean_chromosome, m_to_beta, winsorized
from cytolake.operators import deconv, design, enrich, filters, genes, linmod, model, multitest, neighbours, normalize, planner, plotdata, regions, signature, summaries
from cytolake.plans import closed_forms as cf
from cytolake.plans import fixtures as fx
from cytolake.sources.writers import result_columns, sample_sheet_json

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "fit_two_group"
DIGITS = 9
#: Added before rounding, so that exact halves (of fractions with few bits) fall on the same side in both engines.
NUDGE = 1.25e-12


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to a few digits."""
    return df.select(*[F.round(F.col(f"`{c}`") + NUDGE, DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r(x: str) -> str:
    """A double rounded in SQL, without a negative zero."""
    return f"(round(({x})::DOUBLE + {NUDGE!r}::DOUBLE, {DIGITS}) + 0.0::DOUBLE)"


def groups(spark: SparkSession) -> DataFrame:
    return fx.pheno(spark).select("sample_id", "group")


def study(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> model.Study:
    ann = fx.annotation(spark, sf_dir).withColumn("chromosome", F.when(F.col("chr") == "chr1", "X").when(F.col("chr") == "chr2", "chrY").otherwise(F.col("chr")))
    return model.Study(fx.cells(spark, sf_dir) if cells is None else cells, fx.pheno(spark), ann)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All probes, packed, some with missing cells."""
    return model.pack(fx.cells(spark, sf_dir), fx.YEARS)


def two_groups() -> pd.DataFrame:
    return design.build_design(pd.DataFrame({"group": ["A" if y in fx.GROUP_A else "B" for y in fx.YEARS]}))


GROUPED = "rows_ AS (SELECT c.*, p.grp, p.batch FROM cells c JOIN pheno p USING (sample_id))"
BASE = f"WITH {fx.CELLS}, {fx.PHENO}"


# Sources, model, filters

@query("load_cells_unpivot", f"WITH {fx.CELLS}, p AS (SELECT DISTINCT probe_id FROM cells), y AS (SELECT CAST(y AS VARCHAR) AS sample_id FROM range(1995, 2002) r(y)) "
       f"SELECT probe_id, sample_id, {r('value')} AS value FROM p CROSS JOIN y LEFT JOIN cells USING (probe_id, sample_id)")
def _(spark, sf):
    return model.cells_from_wide(model.wide_from_cells(fx.cells(spark, sf), fx.YEARS), "probe_id")


@query("pack_unpack", f"WITH {fx.CELLS} SELECT probe_id, sample_id, {r('value')} AS value FROM cells")
def _(spark, sf):
    return model.unpack(model.pack(fx.cells(spark, sf), fx.YEARS), fx.YEARS).where("value is not null")


@query("align_missing_samples", f"WITH {fx.CELLS} SELECT DISTINCT sample_id FROM cells WHERE sample_id > '1999'")
def _(spark, sf):
    known = fx.pheno(spark).where("sample_id <= '1999'")
    return fx.cells(spark, sf).select("sample_id").distinct().join(known, "sample_id", "left_anti")


@query("beta_to_m", f"WITH {fx.CELLS}, c AS (SELECT *, least(greatest(value, 1e-6::DOUBLE), 0.999999::DOUBLE) AS b FROM cells) SELECT probe_id, sample_id, {r('log2(b / (1.0::DOUBLE - b))')} AS value FROM c")
def _(spark, sf):
    return normalize.convert(study(spark, sf), "M").cells


@query("m_to_beta", f"WITH {fx.CELLS} SELECT probe_id, sample_id, {r('pow(2.0::DOUBLE, value) / (1.0::DOUBLE + pow(2.0::DOUBLE, value))')} AS value FROM cells")
def _(spark, sf):
    return fx.cells(spark, sf).select("probe_id", "sample_id", m_to_beta("value").alias("value"))


@query("clean_chromosome", """WITH t AS (SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 'chr' WHEN 1 THEN 'CHR' WHEN 2 THEN ' Chr' ELSE '' END) ||
       (CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 7 = 0 THEN 'Y' WHEN p_partkey % 11 = 0 THEN 'MT' ELSE CAST(p_partkey % 22 + 1 AS VARCHAR) END) AS raw FROM part),
       b AS (SELECT *, regexp_replace(trim(raw), '^[cC][hH][rR]', '') AS bare FROM t)
       SELECT p_partkey, raw, 'chr' || CASE WHEN upper(bare) IN ('X', 'Y') THEN upper(bare) ELSE lower(bare) END AS chr FROM b""")
def _(spark, sf):
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "chr").when(k % 4 == 1, "CHR").when(k % 4 == 2, " Chr").otherwise("")
    tail = F.when(k % 5 == 0, "x").when(k % 7 == 0, "Y").when(k % 11 == 0, "MT").otherwise((k % 22 + 1).cast("string"))
    return fx.read(spark, sf, "part").select("p_partkey", F.concat(head, tail).alias("raw")).withColumn("chr", clean_chromosome("raw"))


RATES = "n AS (SELECT count(DISTINCT probe_id) AS n FROM cells), s AS (SELECT sample_id, count(value) AS present, (SELECT n FROM n) AS n FROM cells GROUP BY 1)"


@query("qc_sample_missingness", f"WITH {fx.MONTHLY}, {RATES} SELECT sample_id, n - present AS n_missing, present AS n_present, {r('(n - present)::DOUBLE / n')} AS missing_fraction FROM s")
def _(spark, sf):
    cells = fx.monthly(spark, sf)
    return filters.sample_missingness(cells, cells.select("probe_id").distinct().count())


@query("qc_samples", f"WITH {fx.CELLS}, {RATES}, good AS (SELECT sample_id FROM s WHERE (n - present)::DOUBLE / n <= 0.0125 AND present >= 100) SELECT probe_id, sample_id, {r('value')} AS value FROM cells JOIN good USING (sample_id)")
def _(spark, sf):
    return filters.qc_samples(study(spark, sf), 0.0125, 100).cells


@query("qc_probes", f"WITH {fx.CELLS}, {fx.ANNOTATION}, good AS (SELECT probe_id FROM cells GROUP BY 1 HAVING (7 - count(value)) / 7.0 <= 0.1 EXCEPT SELECT probe_id FROM ann WHERE chr IN ('chr1', 'chr2')) "
       f"SELECT probe_id, sample_id, {r('value')} AS value FROM cells JOIN good USING (probe_id)")
def _(spark, sf):
    return filters.qc_probes(study(spark, sf)).cells


@query("filter_missingness_all_groups", f"{BASE}, {GROUPED}, g AS (SELECT probe_id, grp, count(value) AS n FROM rows_ GROUP BY 1, 2), keep AS (SELECT probe_id FROM g GROUP BY 1 HAVING count(*) = 2 AND min(n) >= 3 AND 7 - sum(n) <= 1.4) "
       f"SELECT probe_id, sample_id, {r('value')} AS value FROM cells JOIN keep USING (probe_id)")
def _(spark, sf):
    return filters.filter_missingness(fx.cells(spark, sf), 7, 0.2, 3, groups(spark))


@query("filter_min_any_group", f"{BASE}, {GROUPED}, keep AS (SELECT DISTINCT probe_id FROM (SELECT probe_id, grp FROM rows_ GROUP BY 1, 2 HAVING count(value) >= 4)) SELECT probe_id, sample_id, {r('value')} AS value FROM cells JOIN keep USING (probe_id)")
def _(spark, sf):
    return filters.filter_min_per_group(fx.cells(spark, sf), groups(spark), 4)


@query("filter_low_variance", f"WITH {fx.CELLS}, v AS (SELECT probe_id, round(var_samp(value), 12) AS v FROM cells GROUP BY 1 HAVING var_samp(value) IS NOT NULL), keep AS (SELECT probe_id FROM v WHERE v >= (SELECT quantile_cont(v, 0.25) FROM v)) "
       "SELECT count(*) AS n_cells, count(DISTINCT probe_id) > 0 AS some FROM cells JOIN keep USING (probe_id)")
def _(spark, sf):
    # Equal variances differ in their last digits between engines, so whole rows at the threshold can't be compared.
    cells = fx.cells(spark, sf)
    v = filters.probe_variance(cells).select("probe_id", F.round("variance", 12).alias("variance")).where("variance is not null")
    keep = v.crossJoin(F.broadcast(v.agg(F.percentile("variance", F.lit(0.25)).alias("least")))).where("variance >= least")
    return cells.join(keep, "probe_id", "left_semi").agg(F.count("*").alias("n_cells"), (F.countDistinct("probe_id") > 0).alias("some"))


@query("low_variance_cells", f"WITH {fx.CELLS}, v AS (SELECT probe_id, var_samp(value) AS v FROM cells GROUP BY 1 HAVING var_samp(value) IS NOT NULL), keep AS (SELECT probe_id FROM v WHERE v >= (SELECT quantile_cont(v, 0.25) FROM v) * (1 - 1e-9)) "
       f"SELECT probe_id, sample_id, {r('value')} AS value FROM cells JOIN keep USING (probe_id)")
def _(spark, sf):
    return filters.filter_low_variance(fx.cells(spark, sf), 25.0)


HOLES = f"WITH {fx.CELLS}, holes AS (SELECT probe_id, sample_id, CASE WHEN (CAST(substr(probe_id, 3) AS BIGINT) + CAST(sample_id AS BIGINT)) % 5 <> 0 THEN value END AS value FROM cells)"


def holes(spark, sf):
    """Every fifth cell taken out."""
    k = (F.substring("probe_id", 3, 20).cast("bigint") + F.col("sample_id").cast("bigint")) % 5
    return fx.cells(spark, sf).withColumn("value", F.when(k != 0, F.col("value")))


for _method, _sql in (("mean", "avg"), ("median", "median")):
    @query(f"impute_{_method}", f"{HOLES}, f AS (SELECT probe_id, {_sql}(value) AS f FROM holes GROUP BY 1) SELECT probe_id, sample_id, {r('coalesce(value, f)')} AS value FROM holes JOIN f USING (probe_id)")
    def _(spark, sf, method=_method):
        return filters.impute(holes(spark, sf), method)


_NEAREST = "sum(v) FILTER (WHERE d = 0) / nullif(count(*) FILTER (WHERE d = 0), 0), sum(v / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0)"


@query("impute_knn_samples", f"WITH {fx.CELLS}, p AS (SELECT DISTINCT probe_id FROM cells), y AS (SELECT CAST(y AS VARCHAR) AS sample_id FROM range(1995, 2002) r(y)), "
       "d AS (SELECT a.sample_id AS s, b.sample_id AS donor, sqrt(sum(pow(a.value - b.value, 2)) * (SELECT count(*) FROM p) / count(*)) AS d FROM cells a JOIN cells b ON a.probe_id = b.probe_id AND a.sample_id <> b.sample_id GROUP BY 1, 2), "
       "holes AS (SELECT probe_id, sample_id FROM p CROSS JOIN y ANTI JOIN cells USING (probe_id, sample_id)), "
       "k AS (SELECT h.probe_id, h.sample_id, d, c.value AS v, row_number() OVER (PARTITION BY h.probe_id, h.sample_id ORDER BY d, donor) AS i FROM holes h JOIN d ON d.s = h.sample_id JOIN cells c ON c.probe_id = h.probe_id AND c.sample_id = d.donor), "
       f"f AS (SELECT probe_id, sample_id, coalesce({_NEAREST}) AS fill FROM k WHERE i <= 3 GROUP BY 1, 2) "
       f"SELECT probe_id, sample_id, {r('coalesce(value, fill)')} AS value FROM p CROSS JOIN y LEFT JOIN cells USING (probe_id, sample_id) LEFT JOIN f USING (probe_id, sample_id)")
def _(spark, sf):
    return model.unpack(neighbours.impute_samples(model.pack(fx.cells(spark, sf), fx.YEARS), 7, 3), fx.YEARS)


MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]
_MONTHS = "months AS (SELECT y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS sample_id, (y - 1995) * 12 + m - 1 AS age, CASE WHEN y >= 1998 THEN 1 ELSE 0 END AS grp FROM range(1995, 2002) a(y), range(1, 13) b(m))"


@query("impute_knn_probes", f"WITH {fx.MONTHLY}, {_MONTHS}, p AS (SELECT DISTINCT probe_id FROM cells), all_ AS (SELECT probe_id, sample_id, value FROM p CROSS JOIN months LEFT JOIN cells USING (probe_id, sample_id)), holes AS (SELECT * FROM all_ WHERE value IS NULL), "
       "d AS (SELECT a.probe_id AS p, b.probe_id AS donor, sqrt(sum(pow(a.value - b.value, 2)) * 84 / count(*)) AS d FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.probe_id <> b.probe_id WHERE a.probe_id IN (SELECT probe_id FROM holes) GROUP BY 1, 2), "
       "k AS (SELECT h.probe_id, h.sample_id, d, c.value AS v, row_number() OVER (PARTITION BY h.probe_id, h.sample_id ORDER BY d, donor) AS i FROM holes h JOIN d ON d.p = h.probe_id JOIN cells c ON c.probe_id = d.donor AND c.sample_id = h.sample_id), "
       f"f AS (SELECT probe_id, sample_id, coalesce({_NEAREST}) AS fill FROM k WHERE i <= 5 GROUP BY 1, 2), m AS (SELECT sample_id, avg(value) AS mean FROM cells GROUP BY 1) "
       f"SELECT probe_id, sample_id, {r('coalesce(value, fill, mean)')} AS value FROM all_ LEFT JOIN f USING (probe_id, sample_id) LEFT JOIN m USING (sample_id)")
def _(spark, sf):
    return model.unpack(neighbours.impute_probes(model.pack(fx.monthly(spark, sf), MONTHS), 84, 5), MONTHS)


# Normalisation and batches

@query("quantile_normalize", f"WITH {fx.CELLS}, m AS (SELECT sample_id, median(value) AS m FROM cells GROUP BY 1), f AS (SELECT c.*, coalesce(value, m) AS filled FROM cells c JOIN m USING (sample_id)), "
       "k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY filled, probe_id) AS rank FROM f), t AS (SELECT rank, avg(filled) AS target FROM k GROUP BY 1) "
       f"SELECT probe_id, sample_id, {r('CASE WHEN value IS NOT NULL THEN target END')} AS value FROM k JOIN t USING (rank)")
def _(spark, sf):
    return normalize.normalize(study(spark, sf)).cells


BATCH = (f"{BASE}, {GROUPED}, m AS (SELECT probe_id, count(*) AS n, avg(value) FILTER (WHERE batch = 1) AS m1, avg(value) FILTER (WHERE batch = 0) AS m0 FROM rows_ GROUP BY 1), "
         "b AS (SELECT probe_id, m0, CASE WHEN m0 IS NULL THEN m1 / 2 WHEN m1 IS NULL THEN 0 ELSE m1 - m0 END AS b, n = 7 AS whole FROM m)")


@query("batch_regression", f"{BATCH}, y AS (SELECT CAST(y AS VARCHAR) AS sample_id FROM range(1995, 2002) r(y)) SELECT probe_id, sample_id, {r('CASE WHEN whole THEN value - CASE WHEN batch = 1 THEN b ELSE 0 END END')} AS value FROM b CROSS JOIN y LEFT JOIN rows_ USING (probe_id, sample_id)")
def _(spark, sf):
    pheno = fx.pheno(spark).orderBy("sample_id").toPandas()
    return model.unpack(normalize.batch_corrected(packed(spark, sf), pheno, "batch"), fx.YEARS)


@query("batch_regression_missing", f"{BATCH} SELECT probe_id, sample_id, {r('value - CASE WHEN batch = 1 THEN b ELSE 0 END')} AS value FROM rows_ JOIN b USING (probe_id)")
def _(spark, sf):
    pheno = fx.pheno(spark).orderBy("sample_id").toPandas()
    return model.unpack(normalize.batch_corrected(packed(spark, sf), pheno, "batch", missing="ols"), fx.YEARS).where("value is not null")


@query("batch_diagnostics", f"{BATCH}, o AS (SELECT probe_id, sum(pow(value - CASE WHEN batch = 1 THEN m0 + b ELSE m0 END, 2)) AS ss FROM rows_ JOIN b USING (probe_id) GROUP BY 1) "
       f"SELECT probe_id, {r('CASE WHEN whole THEN m0 END')} AS intercept, {r('CASE WHEN whole THEN b END')} AS batch, {r('CASE WHEN whole THEN ss END')} AS residual FROM b JOIN o USING (probe_id)")
def _(spark, sf):
    pheno = fx.pheno(spark).orderBy("sample_id").toPandas()
    square = F.aggregate("residuals", F.lit(0.0), lambda s, v: s + v * v)
    return normalize.batch_diagnostics(packed(spark, sf), pheno, "batch").select("probe_id", F.col("effects")[0].alias("intercept"), F.col("effects")[1].alias("batch"), square.alias("residual"))


@query("batch_variance_explained", f"{BATCH} SELECT probe_id, {r('CASE WHEN whole THEN b * b * 4.0 / 7.0 END')} AS batch_term FROM b")
def _(spark, sf):
    pheno = fx.pheno(spark).orderBy("sample_id").toPandas()
    return normalize.batch_variance(packed(spark, sf), pheno, "batch").select("probe_id", F.col("term_1").alias("batch_term"))


STANDARD = (f"{BASE}, {GROUPED}, o AS (SELECT probe_id, batch, avg(value) AS mb, coalesce(stddev_samp(value), 0) AS sb FROM rows_ GROUP BY 1, 2), a AS (SELECT probe_id, stddev_samp(value) AS s FROM rows_ GROUP BY 1) "
            "SELECT probe_id, sample_id, {v} AS value FROM rows_ JOIN o USING (probe_id, batch) JOIN a USING (probe_id)")


@query("batch_location_scale", STANDARD.replace("{v}", r("(value - mb) / CASE WHEN sb > 1e-9 THEN sb ELSE 1 END * coalesce(s, 1.0)")))
def _(spark, sf):
    cells = fx.cells(spark, sf)
    return normalize.batch_standardized(cells, fx.pheno(spark))


@query("batch_combat", STANDARD.replace(f"WITH {fx.CELLS}", f"WITH {fx.CELLS.replace('cells AS', 'betas AS', 1)}, c_ AS (SELECT *, least(greatest(value, 1e-6::DOUBLE), 0.999999::DOUBLE) AS b FROM betas), cells AS (SELECT probe_id, sample_id, log2(b / (1.0::DOUBLE - b)) AS value FROM c_)").replace(
    "{v}", r("1 / (1 + pow(2.0::DOUBLE, -((value - mb) / CASE WHEN sb > 1e-9 THEN sb ELSE 1 END * coalesce(s, 1.0))))")))
def _(spark, sf):
    return normalize.combat(study(spark, sf), "batch").cells


_EMPIRICAL = (f"WITH RECURSIVE {fx.CELLS.replace('cells AS', 'betas AS', 1)}, {fx.PHENO}, c_ AS (SELECT *, least(greatest(value, 1e-6::DOUBLE), 0.999999::DOUBLE) AS b FROM betas), "
              "whole AS (SELECT probe_id FROM betas GROUP BY 1 HAVING count(*) = 7), w AS (SELECT probe_id, sample_id, batch, log2(b / (1.0::DOUBLE - b)) AS y FROM c_ JOIN whole USING (probe_id) JOIN pheno USING (sample_id)), "
              "m_ AS (SELECT probe_id, batch, avg(y) AS mb, var_samp(y) AS vb, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2), "
              "a_ AS (SELECT probe_id, sum(mb * n) / 7 AS mean, sqrt(sum(vb * (n - 1)) / 7) AS spread FROM m_ GROUP BY 1), "
              "h AS (SELECT probe_id, batch, n, (mb - mean) / spread AS hat, vb / (spread * spread) AS var FROM m_ JOIN a_ USING (probe_id) WHERE spread > 1e-9), "
              "p AS (SELECT batch, avg(hat) AS g0, var_samp(hat) AS t2, avg(var) AS m, var_samp(var) AS v FROM h GROUP BY 1), "
              "s AS (SELECT 0 AS k, probe_id, batch, n, hat, var, g0, t2, 2 + m * m / v AS a, m + m * m * m / v AS c, hat AS g, var AS d FROM h JOIN p USING (batch) UNION ALL "
              "SELECT k + 1, probe_id, batch, n, hat, var, g0, t2, a, c, new, (((n - 1) * var + n * (hat - new) * (hat - new)) / 2 + c) / (n / 2 + a - 1) FROM (SELECT *, (t2 * n * hat + d * g0) / (t2 * n + d) AS new FROM s WHERE k < 100)), "
              "f AS (SELECT w.*, CASE WHEN d IS NULL THEN y ELSE ((y - mean) / spread - g) / sqrt(d) * spread + mean END AS z FROM w JOIN a_ USING (probe_id) LEFT JOIN (SELECT * FROM s WHERE k = 100) e USING (probe_id, batch)) ")


@query("batch_combat_parametric", _EMPIRICAL + f"SELECT probe_id, sample_id, {r('1 / (1 + pow(2.0::DOUBLE, -z))')} AS value FROM f")
def _(spark, sf):
    return normalize.combat(study(spark, sf), "batch", method="parametric").cells.where("value is not null")


# Designs and linear models

@query("build_design", "SELECT CAST(y AS VARCHAR) AS sample_id, 1.0::DOUBLE AS intercept, CASE WHEN y > 1997 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"group_B\" FROM range(1995, 2002) r(y)")
def _(spark, sf):
    return design.dummies(fx.pheno(spark), "group", ["A", "B"])


@query("pairs_report", "SELECT CAST(o_custkey AS BIGINT) AS pair, count(*) AS n, count(DISTINCT o_orderstatus) AS n_groups FROM orders GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT o_orderstatus) <> 2")
def _(spark, sf):
    return design.pairs_report(fx.read(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("group_means", f"{BASE}, {GROUPED} SELECT probe_id, {r('avg(value) FILTER (WHERE grp = chr(65))')} AS mean_A, {r('avg(value) FILTER (WHERE grp = chr(66))')} AS mean_B FROM rows_ GROUP BY 1")
def _(spark, sf):
    return summaries.group_means(fx.cells(spark, sf), groups(spark), ["A", "B"])


@query("group_means_long", "WITH m AS (SELECT l_returnflag AS g, avg(CAST(l_quantity AS BIGINT)) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"{r(f'CASE WHEN l_returnflag = chr({ord(g)}) THEN m END')} AS mean_{g}" for g in "ANR") + " FROM lineitem JOIN m ON g = l_returnflag")
def _(spark, sf):
    rows = fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return summaries.group_means_long(rows, "l_returnflag", "q", ["A", "N", "R"]).drop("q", "l_returnflag")


@query("summarize_groups", f"{BASE}, {GROUPED} SELECT probe_id, " + ", ".join(f"{r(f'avg(value) FILTER (WHERE grp = chr({ord(g)}))')} AS mean_{g}, {r(f'var_samp(value) FILTER (WHERE grp = chr({ord(g)}))')} AS var_{g}" for g in "AB") + " FROM rows_ GROUP BY 1")
def _(spark, sf):
    return summaries.summarize_groups(fx.cells(spark, sf), groups(spark), ["A", "B"])


@query("winsorize_rows", f"{BASE}, q AS (SELECT probe_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM cells GROUP BY 1) SELECT probe_id, sample_id, {r('least(greatest(value, lo), hi)')} AS value FROM cells JOIN q USING (probe_id)")
def _(spark, sf):
    return model.unpack(packed(spark, sf).select("probe_id", winsorized(F.col("values")).alias("values")), fx.YEARS).where("value is not null")


#: Fits of two groups over all probes with three present cells: values, in groups ``na`` and ``n - na``, the fit and its variance.
def _two_groups(robust: bool) -> str:
    y = "least(greatest(value, lo), hi)" if robust else "value"
    return (f"{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {GROUPED}, q_ AS (SELECT probe_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM rows_ GROUP BY 1), w AS (SELECT probe_id, sample_id, grp, {y} AS y FROM rows_ JOIN q_ USING (probe_id)), "
            "m AS (SELECT probe_id, count(*) AS n, count(*) FILTER (WHERE grp = 'A') AS na, avg(y) FILTER (WHERE grp = 'A') AS ma, avg(y) FILTER (WHERE grp = 'B') AS mb, avg(y) AS m0, var_pop(y) AS v FROM w GROUP BY 1 HAVING count(*) >= 3), "
            "e AS (SELECT probe_id, sum(pow(y - CASE WHEN grp = 'A' THEN ma ELSE mb END, 2)) AS ss FROM w JOIN m USING (probe_id) GROUP BY 1), "
            "d_ AS (SELECT *, n - CASE WHEN na IN (0, n) THEN 1 ELSE 2 END AS df, CASE WHEN na = 0 THEN m0 / 2 WHEN na = n THEN 0 ELSE mb - ma END AS fc FROM m JOIN e USING (probe_id)), "
            "g AS (SELECT probe_id, fc, df, ss / df AS s2 FROM d_ WHERE v >= 1e-12 AND df > 0)")


def _tested(table: str, unscaled: str, points: int) -> str:
    """The t-test and its adjustment of ``table(probe_id, fc, s2, s2_post, df_total)``."""
    return (f"se AS (SELECT *, sqrt(greatest(s2_post * ({unscaled}), 1e-8)) AS se FROM {table}), t AS (SELECT *, CASE WHEN se < 1e-3 THEN 0 ELSE fc / se END AS t FROM se), "
            f"p AS (SELECT *, {cf.t_pvalue('t', 'df_total', points)} AS p FROM t), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n_ FROM p), "
            "a AS (SELECT *, least(1.0::DOUBLE, min(p * n_ / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o) "
            f"SELECT probe_id, {r('fc')} AS \"logFC\", {r('s2')} AS s2, {r('s2_post')} AS s2_post, {r('t')} AS t, {r('p')} AS pval, {r('q')} AS padj FROM a")


def fit_sql(d0: float, robust: bool = False) -> str:
    """The whole two-group test in SQL with ``d0`` prior degrees of freedom and the median as the prior's variance."""
    post = "s2" if not d0 else f"greatest(({d0}::DOUBLE * s0 + df * s2) / (df + {d0}::DOUBLE), 1e-12)"
    return f"{_two_groups(robust)}, h AS (SELECT median(s2) AS s0 FROM g), k AS (SELECT g.*, {post} AS s2_post, df + {d0}::DOUBLE AS df_total FROM g, h), {_tested('k', '1.0::DOUBLE / 3 + 1.0::DOUBLE / 4', 2000)}"


FIT = ["probe_id", "logFC", "s2", "s2_post", "t", "pval", "padj"]


@query("fit_two_group", fit_sql(0))
def _(spark, sf):
    return linmod.fit_differential(packed(spark, sf), two_groups(), contrast=[0, 1], shrink="none", robust=False).select(*FIT)


@query("fit_robust", fit_sql(0, robust=True))
def _(spark, sf):
    return linmod.fit_differential(packed(spark, sf), two_groups(), contrast=[0, 1], shrink="auto").select(*FIT)


@query("fit_fixed_prior", fit_sql(10))
def _(spark, sf):
    return linmod.fit_differential(packed(spark, sf), two_groups(), contrast=[0, 1], shrink=10.0, robust=False).select(*FIT)


@query("fit_median_prior", fit_sql(3.5))
def _(spark, sf):
    return linmod.fit_differential(packed(spark, sf), two_groups(), contrast=[0, 1], shrink="median", robust=False).select(*FIT)


#: A group and a trend over months: centred sums give the two slopes. The test is of the group.
_SUMS = ", ".join(f"sum({x} * {y}) - sum({x}) * sum({y}) / count(*) AS {x}{y}" for x, y in ("aa", "gg", "ag", "ay", "gy", "yy"))
_TREND = (f"WITH RECURSIVE {fx.MONTHLY}, {_MONTHS}, q_ AS (SELECT probe_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM cells GROUP BY 1), "
          "w AS (SELECT probe_id, age::DOUBLE AS a, grp::DOUBLE AS g, least(greatest(value, lo), hi) AS y FROM cells JOIN q_ USING (probe_id) JOIN months USING (sample_id)), "
          f"s_ AS (SELECT probe_id, count(*) AS n, {_SUMS} FROM w GROUP BY 1 HAVING count(*) >= 4 AND var_pop(y) >= 1e-12), "
          "b_ AS (SELECT probe_id, n - 3 AS df, (gy * aa - ay * ag) / (aa * gg - ag * ag) AS fc, (ay * gg - gy * ag) / (aa * gg - ag * ag) AS slope, yy, ay, gy FROM s_), "
          "g AS (SELECT probe_id, 0 AS chunk, fc, df, (yy - fc * gy - slope * ay) / df AS s2 FROM b_), "
          f"{cf.prior('g')}, k AS (SELECT g.*, greatest((d0 * s0 + df * s2) / (df + d0), 1e-12) AS s2_post, df + d0 AS df_total FROM g JOIN prior USING (chunk)), "
          "x_ AS (SELECT sum(age * age) - sum(age) * sum(age) / 84.0 AS aa, sum(grp) - sum(grp) * sum(grp) / 84.0 AS gg, sum(age * grp) - sum(age) * sum(grp) / 84.0 AS ag FROM months)")


@query("fit_smyth_missing", f"{_TREND}, {_tested('k', '(SELECT aa / (aa * gg - ag * ag) FROM x_)', 4000)}")
def _(spark, sf):
    cells = model.pack(fx.monthly(spark, sf), MONTHS)
    x = design.build_design(pd.DataFrame({"group": ["A" if m < "1998" else "B" for m in MONTHS], "age": np.arange(len(MONTHS), dtype=float)}))
    return linmod.fit_differential(cells, x, contrast=[0, 0, 1], shrink="smyth").select(*FIT)


@query("fit_chunked", f"{_two_groups(True)}, c_ AS (SELECT *, CAST('0x' || substr(md5(probe_id), 1, 8) AS BIGINT) % (SELECT greatest(1, count(*) // 500) FROM g) AS chunk FROM g), "
       f"{cf.prior('c_')}, k AS (SELECT c_.*, greatest((d0 * s0 + df * s2) / (df + d0), 1e-12) AS s2_post, df + d0 AS df_total FROM c_ JOIN prior USING (chunk)), {_tested('k', '1.0::DOUBLE / 3 + 1.0::DOUBLE / 4', 2000)}")
def _(spark, sf):
    return linmod.fit_chunked(packed(spark, sf), two_groups(), [0, 1], chunk=500).select(*FIT)


THREE = "CASE CAST(sample_id AS BIGINT) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"


# Three groups of 3, 2 and 2 samples. Effects are the least ones that fit, also where a group has no cell; their quadratic form is that of the whole design.
@query("fit_f_test", f"{BASE}, {GROUPED}, t3 AS (SELECT *, {THREE} AS g3 FROM rows_), m AS (SELECT probe_id, count(*) AS n, var_pop(value) AS v, " + ", ".join(f"avg(value) FILTER (WHERE g3 = '{g}') AS m{g}" for g in "abc") + " FROM t3 GROUP BY 1 HAVING count(*) >= 4), "
       "w AS (SELECT probe_id, sum(pow(value - CASE g3 WHEN 'a' THEN ma WHEN 'b' THEN mb ELSE mc END, 2)) AS ss FROM t3 JOIN m USING (probe_id) GROUP BY 1), "
       "e AS (SELECT *, n - 3 + CASE WHEN ma IS NULL OR mb IS NULL OR mc IS NULL THEN 1 ELSE 0 END AS df, coalesce(mb - coalesce(ma, (mb + mc) / 3), 0) AS b1, coalesce(mc - coalesce(ma, (mb + mc) / 3), 0) AS b2 FROM m JOIN w USING (probe_id) WHERE v >= 1e-12), "
       "f AS (SELECT probe_id, df, ss / df AS s2, (2 * b1 * b1 + 2 * b2 * b2 - pow(2 * b1 + 2 * b2, 2) / 7) / 2 / greatest(ss / df, 1e-8) AS f FROM e WHERE df > 0), p AS (SELECT *, pow(1 + 2 * f / df, -df / 2.0::DOUBLE) AS p FROM f), "
       "o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p) "
       f"SELECT probe_id, {r('s2')} AS s2, {r('f')} AS \"F\", {r('p')} AS pval, {r('least(1.0::DOUBLE, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING))')} AS padj FROM o")
def _(spark, sf):
    x = design.build_design(pd.DataFrame({"g": ["abc"[int(y) % 3] for y in fx.YEARS]}))
    return linmod.fit_differential(packed(spark, sf), x, contrast_matrix=[[0, 1, 0], [0, 0, 1]], shrink="none", robust=False).select("probe_id", "s2", "F", "pval", "padj")


@query("fit_many_groups", f"WITH RECURSIVE {fx.EMBEDDING}, n_ AS (SELECT count(DISTINCT sample_id) AS n, count(DISTINCT grp)::DOUBLE AS k FROM cells), q_ AS (SELECT probe_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, avg(value) AS m0 FROM cells GROUP BY 1), "
       "m_ AS (SELECT probe_id, grp, avg(value) AS m, count(*) AS c FROM cells GROUP BY 1, 2), "
       "s_ AS (SELECT probe_id, sum(pow(least(greatest(value, lo), hi) - m, 2)) / ((SELECT n FROM n_) - (SELECT k FROM n_)) AS s2 FROM cells JOIN q_ USING (probe_id) JOIN m_ USING (probe_id, grp) GROUP BY 1), "
       "b_ AS (SELECT probe_id, sum(c * pow(m - m0, 2)) AS ssb FROM m_ JOIN q_ USING (probe_id) GROUP BY 1), g AS (SELECT 0 AS chunk, * FROM s_ JOIN b_ USING (probe_id)), "
       f"{cf.prior('g')}, k_ AS (SELECT g.*, n - k AS df, k - 1 AS df1, n - k + d0 AS df2, greatest((d0 * s0 + (n - k) * s2) / (n - k + d0), 1e-12) AS s2_post FROM g JOIN prior USING (chunk), n_), "
       "f_ AS (SELECT *, ssb / df1 / greatest(s2_post, 1e-8) AS f FROM k_), "
       f"p AS (SELECT *, {cf.f_pvalue('f', 'df1', 'df2')} AS p FROM f_), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n_ FROM p) "
       f"SELECT probe_id, {r('s2')} AS s2, {r('s2_post')} AS s2_post, {r('f')} AS \"F\", {r('df1')} AS df1, {r('df2')} AS df2, {r('p')} AS pval, {r('least(1.0::DOUBLE, min(p * n_ / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING))')} AS padj FROM o")
def _(spark, sf):
    cells = fx.embedding_cells(spark, sf)
    samples = fx.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("group"))
    return linmod.fit_groups(cells, samples, shrink="smyth").select("probe_id", "s2", "s2_post", "F", "df1", "df2", "pval", "padj")


@query("residuals", f"{_two_groups(False)} SELECT w.probe_id, sample_id, {r('y - CASE WHEN grp = chr(65) THEN ma ELSE mb END')} AS residual FROM w JOIN m USING (probe_id) JOIN g USING (probe_id)")
def _(spark, sf):
    got = linmod.fitted(packed(spark, sf), two_groups(), np.array([0, 1]), robust=False, residuals=True)
    return model.unpack(got.select("probe_id", F.col("residuals").alias("values")), fx.YEARS).where("value is not null").withColumnRenamed("value", "residual")


# Many tests

RES = f"WITH {fx.results_sql()}"
_ORDER = "o AS (SELECT *, row_number() OVER (ORDER BY pval, probe_id) AS i, count(*) OVER () AS m FROM res)"
_UP, _DOWN = "OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)", "OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)"
_ADJUST = {
    "fdr_bh": f"min(pval * m / i) {_UP}", "fdr_by": f"min(pval * m / i) {_UP} * (SELECT sum(1.0::DOUBLE / j) FROM range(1, (SELECT count(*) + 1 FROM res)) h(j))",
    "holm": f"max(pval * (m - i + 1)) {_DOWN}", "simes-hochberg": f"min(pval * (m - i + 1)) {_UP}", "bonferroni": "pval * m",
    "sidak": "1 - pow(1 - pval, m)", "holm-sidak": f"max(1 - pow(1 - pval, m - i + 1)) {_DOWN}",
}
for _method, _sql in _ADJUST.items():
    @query(f"adjust_{_method.replace('-', '_')}", f"{RES}, {_ORDER} SELECT probe_id, {r(f'least(1.0::DOUBLE, {_sql})')} AS adjusted FROM o")
    def _(spark, sf, method=_method):
        return multitest.adjust(fx.results(spark, sf).select("probe_id", "pval"), "pval", "adjusted", method).select("probe_id", "adjusted")


@query("stouffer", f"{RES.replace('WITH ', 'WITH RECURSIVE ', 1)}, d_ AS (SELECT DISTINCT pval AS id, pval FROM res), {cf.normal_quantiles('d_', 'pval')}, s AS (SELECT sum(z) / sqrt(count(*)) AS z FROM res JOIN z ON id = pval) "
       f"SELECT {r('z')} AS z, {r('1 - ' + cf.normal_cdf('z'))} AS pvalue FROM s")
def _(spark, sf):
    return multitest.stouffer(fx.results(spark, sf), "pval")


# Effects and summaries

@query("delta_beta", f"{BASE}, {GROUPED}, a AS (SELECT probe_id, avg(value) AS v FROM rows_ WHERE grp = 'A' GROUP BY 1), b AS (SELECT probe_id, avg(value) AS v FROM rows_ WHERE grp = 'B' GROUP BY 1) SELECT probe_id, {r('abs(a.v - b.v)')} AS delta FROM a LEFT JOIN b USING (probe_id)")
def _(spark, sf):
    rows = filters.with_groups(fx.cells(spark, sf), groups(spark))
    a, b = (rows.where(F.col("group") == g).groupBy("probe_id").agg(F.avg("value").alias("v")) for g in "AB")
    return summaries.delta(a, b, "probe_id", "v", as_abs=True)


for _method, _factor in (("cohens_d", "1"), ("hedges_g", "(1 - 3.0::DOUBLE / (4 * 7 - 9))")):
    @query(_method, f"{BASE}, {GROUPED}, e AS (SELECT probe_id, avg(value) FILTER (WHERE grp = 'A') AS a, avg(value) FILTER (WHERE grp = 'B') AS b, sqrt((2 * var_samp(value) FILTER (WHERE grp = 'A') + 3 * var_samp(value) FILTER (WHERE grp = 'B')) / 5) AS s FROM rows_ GROUP BY 1) "
           f"SELECT probe_id, {r(f'coalesce(CASE WHEN s <> 0 THEN (a - b) / s END, 0) * {_factor}')} AS effect FROM e")
    def _(spark, sf, method=_method):
        return summaries.effect_size(fx.cells(spark, sf), groups(spark), "A", "B", 3, 4, method)


@query("filter_dms_hyper", f"{RES} SELECT probe_id, {r('logFC')} AS \"logFC\", {r('padj')} AS padj FROM res WHERE padj <= 0.25 AND logFC >= 0.5")
def _(spark, sf):
    return summaries.filter_dms(fx.results(spark, sf), pval_thresh=0.25, lfc_thresh=0.5, direction="hyper").select("probe_id", "logFC", "padj")


@query("significant_cpgs", f"{RES} SELECT probe_id FROM res WHERE padj < 0.3 AND abs(logFC) >= 1")
def _(spark, sf):
    return summaries.significant(fx.results(spark, sf), lfc_thresh=1.0, pval_thresh=0.3).select("probe_id")


@query("summarize_results", f"{RES} SELECT count(*) AS total_tested, count(*) FILTER (WHERE padj < 0.3) AS significant, count(*) FILTER (WHERE padj < 0.3 AND logFC >= 0.5) AS hypermethylated, count(*) FILTER (WHERE padj < 0.3 AND logFC <= -0.5) AS hypomethylated, "
       f"{r('count(*) FILTER (WHERE padj < 0.3)::DOUBLE / count(*)')} AS pct_significant, {r('avg(abs(logFC)) FILTER (WHERE padj < 0.3)')} AS \"mean_abs_logFC\", {r('median(abs(logFC))')} AS \"median_abs_logFC\", {r('max(abs(logFC))')} AS \"max_abs_logFC\", "
       f"{r('min(pval)')} AS min_pval, {r('median(s2_post) / median(s2)')} AS shrinkage_factor, {r('median(d0)')} AS median_d0 FROM res")
def _(spark, sf):
    return summaries.summarize_results(fx.results(spark, sf), 0.3, 0.5)


@query("reproducibility", f"WITH {fx.results_sql('a')}, {fx.results_sql('b0', 7919)}, b AS (SELECT * REPLACE (CASE WHEN CAST(substr(probe_id, 3) AS BIGINT) % 3 = 0 THEN -logFC + 0.5 ELSE logFC END AS logFC) FROM b0 WHERE CAST(substr(probe_id, 3) AS BIGINT) % 4 <> 0), "
       "j AS (SELECT a.probe_id, a.logFC AS e1, b.logFC AS e2, a.padj < 0.3 AS s1, b.padj < 0.3 AS s2 FROM a JOIN b USING (probe_id)), "
       "k AS (SELECT *, rank() OVER (ORDER BY e1) + (count(*) OVER (PARTITION BY e1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY e2) + (count(*) OVER (PARTITION BY e2) - 1) / 2.0 AS r2 FROM j) "
       "SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, count(*) AS n_overlap, (SELECT count(*) FROM a WHERE padj < 0.3) AS n_sig1, (SELECT count(*) FROM b WHERE padj < 0.3) AS n_sig2, count(*) FILTER (WHERE s1 AND s2) AS n_sig_overlap, "
       f"{r('avg(CASE WHEN sign(e1) = sign(e2) THEN 1.0 ELSE 0.0 END)')} AS sign_concordance, {r('count(*)::DOUBLE / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - count(*))')} AS jaccard, {r('corr(r1, r2)')} AS spearman FROM k")
def _(spark, sf):
    k = F.substring("probe_id", 3, 20).cast("bigint")
    b = fx.results(spark, sf, 7919).where(k % 4 != 0).withColumn("logFC", F.when(k % 3 == 0, -F.col("logFC") + 0.5).otherwise(F.col("logFC")))
    return summaries.reproducibility(fx.results(spark, sf), b, pval_thresh=0.3)


# Regions

_CLUSTER = (f"WITH {fx.SITES}, s AS (SELECT *, milli / 1000.0::DOUBLE AS fc FROM sites WHERE padj <= 0.05), l AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, probe_id) <= {{gap}} THEN 0 ELSE 1 END AS new FROM s), "
            "c AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos, probe_id ROWS UNBOUNDED PRECEDING) AS k FROM l), "
            "d AS (SELECT chr, min(pos) AS start_, max(pos) AS end_, count(*) AS n_cpgs, avg(fc) AS fc, min(padj) AS p, string_agg(probe_id, ',' ORDER BY pos, probe_id) AS cpgs FROM c GROUP BY chr, k HAVING count(*) >= {least})")


def found(spark, sf, gap, least, **more):
    s = fx.sites(spark, sf)
    dms = s.select("probe_id", "padj", (F.col("milli") / F.lit(1000.0)).alias("logFC"))
    return regions.find_regions(dms, s.select("probe_id", "chr", "pos"), max_gap=gap, min_cpgs=least, **more)


@query("dmr_clusters", _CLUSTER.format(gap=3600, least=3) + f" SELECT chr, start_ AS start, end_ AS \"end\", n_cpgs, {r('fc')} AS \"mean_logFC\", {r('p')} AS min_padj, cpgs FROM d")
def _(spark, sf):
    return found(spark, sf, 3600, 3).drop("mean_delta_beta").withColumn("cpgs", F.concat_ws(",", "cpgs"))


_MERGED = (_CLUSTER.format(gap=1800, least=2) + ", f AS (SELECT *, max(end_) OVER (PARTITION BY chr ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM d), "
           "g AS (SELECT *, sum(CASE WHEN far IS NULL OR start_ - far > 5400 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS id FROM f) ")


@query("dmr_merged", _MERGED + f"SELECT chr, min(start_) AS start, max(end_) AS \"end\", CAST(sum(n_cpgs) AS BIGINT) AS n_cpgs, {r('sum(fc * n_cpgs) / sum(n_cpgs)')} AS \"mean_logFC\", {r('min(p)')} AS min_padj FROM g GROUP BY chr, id")
def _(spark, sf):
    return found(spark, sf, 1800, 2, merge_distance=5400, merge_mean="weighted").drop("mean_delta_beta", "cpgs")


@query("dmr_merged_sequential", _MERGED + f"SELECT chr, min(start_) AS start, max(end_) AS \"end\", CAST(sum(n_cpgs) AS BIGINT) AS n_cpgs, {r('list_reduce(list(fc ORDER BY start_, end_), lambda a, b: (a + b) / 2)')} AS \"mean_logFC\", {r('min(p)')} AS min_padj FROM g GROUP BY chr, id")
def _(spark, sf):
    return found(spark, sf, 1800, 2, merge_distance=5400).drop("mean_delta_beta", "cpgs")


@query("summarize_regions", _CLUSTER.format(gap=3600, least=3) + f" SELECT count(*) AS n_regions, CAST(floor(median(end_ - start_)) AS BIGINT) AS median_length, {r('avg(n_cpgs)')} AS mean_n_cpgs, 0.0::DOUBLE AS mean_delta_beta, {r('min(p)')} AS min_padj FROM d")
def _(spark, sf):
    return regions.summarize_regions(found(spark, sf, 3600, 3))


# Genes, sets, expression

@query("gene_overlaps", f"WITH {fx.ANNOTATION}, {fx.GENES} SELECT a.probe_id, g.gene_symbol FROM ann a JOIN genes g ON a.chr = g.chr AND a.pos BETWEEN g.s AND g.e")
def _(spark, sf):
    return genes.overlapping(fx.annotation(spark, sf).select("probe_id", "chr", "pos"), fx.genes(spark, sf)).select("probe_id", "gene_symbol")


@query("map_to_genes", f"WITH {fx.ANNOTATION}, {fx.GENES}, j AS (SELECT a.probe_id, a.pos, g.*, greatest(g.s - a.pos, a.pos - g.e, 0) AS d FROM ann a JOIN genes g ON a.chr = g.chr), "
       "b AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, gene_ord) AS i FROM j), "
       "k AS (SELECT *, CASE WHEN strand = '+' THEN pos - s ELSE e - pos END AS up, abs(pos - CASE WHEN strand = '+' THEN s ELSE e END) AS far FROM b WHERE i = 1), "
       "c AS (SELECT probe_id, CASE WHEN d > 20000 THEN NULL ELSE gene_symbol END AS nearest_gene, CASE WHEN d > 20000 THEN 'intergenic' WHEN d = 0 THEN 'gene_body' WHEN up BETWEEN -200 AND 0 THEN 'proximal_promoter' WHEN up BETWEEN 1 AND 500 THEN 'promoter_downstream' "
       "WHEN up >= -1500 AND up < -200 THEN 'distal_promoter' WHEN up >= -5000 AND up < -1500 THEN 'distal_upstream' ELSE 'intergenic' END AS relation, CASE WHEN d > 20000 THEN NULL WHEN d = 0 THEN 0 ELSE far END AS distance_bp FROM k) "
       "SELECT probe_id, nearest_gene, relation, distance_bp FROM ann LEFT JOIN c USING (probe_id)")
def _(spark, sf):
    return genes.map_to_genes(fx.annotation(spark, sf).select("probe_id", "chr", "pos"), fx.genes(spark, sf), max_distance=20_000).drop("chr", "pos")


@query("liftover", f"WITH {fx.GENES}, b AS (SELECT DISTINCT chr, k FROM genes, range(0, 400) r(k)), "
       "l AS (SELECT g.*, s // 50000 AS ks, e // 50000 AS ke, s % 50000 < 40000 AND e % 50000 < 40000 AND s >= 0 AS ok FROM genes g) "
       "SELECT gene_symbol, ok AS lifted, CASE WHEN ok THEN chr END AS chr, CASE WHEN ok THEN s + 1000 * ks + 500 END AS start, CASE WHEN ok THEN e + 1000 * ke + 500 END AS \"end\" FROM l")
def _(spark, sf):
    g = fx.genes(spark, sf)
    # A chain of 40 000 aligned bases in every 50 000, each block moved by 1000 more than the one before.
    blocks = g.select("chr").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20_000)))).select(
        "chr", (F.col("k") * 50_000).cast("bigint").alias("start"), (F.col("k") * 50_000 + 40_000).cast("bigint").alias("end"), F.col("chr").alias("to_chr"),
        (F.col("k") * 51_000 + 500).cast("bigint").alias("to_start"), F.lit(10**10).alias("to_size"), F.lit("+").alias("to_strand"))
    return genes.liftover(g.select("chr", "start", "end", "gene_symbol"), blocks)


@query("enrichment", f"WITH {fx.ANNOTATION}, l AS (SELECT DISTINCT gene FROM ann WHERE CAST(substr(probe_id, 3) AS BIGINT) % 37 = 0), s AS (SELECT DISTINCT chr AS term, gene FROM ann), n AS (SELECT (SELECT count(*) FROM l) AS g, (SELECT count(DISTINCT gene) FROM s) AS t), "
       "c AS (SELECT term, count(*) AS m, count(l.gene) AS a FROM s LEFT JOIN l USING (gene) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500), "
       "f AS (SELECT term, a, m, g, t, (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(t - m + 1) - lgamma(g - i + 1) - lgamma(t - m - g + i + 1) - lgamma(t + 1) + lgamma(g + 1) + lgamma(t - g + 1))) "
       "FROM range(0, 200) r(i) WHERE i >= a AND i <= least(m, g) AND g - i <= t - m) AS p FROM c, n WHERE m - a >= 0 AND g - a >= 0 AND t - m - g + a >= 0), "
       "o AS (SELECT *, row_number() OVER (ORDER BY p, term) AS i, count(*) OVER () AS n FROM f), q AS (SELECT *, least(1.0::DOUBLE, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o) "
       f"SELECT term, a AS overlap, m AS set_size, {r('least(p, 1.0::DOUBLE)')} AS pvalue, {r('q')} AS padj FROM q")
def _(spark, sf):
    a = fx.annotation(spark, sf)
    listed = a.where(F.substring("probe_id", 3, 20).cast("bigint") % 37 == 0).select("gene")
    return enrich.enrichment(listed, a.select(F.col("chr").alias("term"), "gene"), cutoff=None).drop("odds_ratio")


for _method, _sql in (("mean", "avg"), ("median", "median"), ("sum", "sum")):
    @query(f"pathway_{_method}", f"WITH {fx.CELLS}, {fx.ANNOTATION}, s AS (SELECT DISTINCT chr AS pathway, gene FROM ann), m AS (SELECT DISTINCT probe_id, s.pathway FROM ann JOIN s USING (gene)) SELECT sample_id, pathway, {r(f'{_sql}(value)')} AS score FROM cells JOIN m USING (probe_id) GROUP BY 1, 2")
    def _(spark, sf, method=_method):
        a = fx.annotation(spark, sf)
        return enrich.pathway_scores(fx.cells(spark, sf), a, a.select(F.col("chr").alias("term"), "gene"), method)


_EXPRESSION = ("x AS (SELECT l_partkey, 'cg' || l_partkey AS probe_id, CAST(year(l_shipdate) AS VARCHAR) AS sample_id, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS y FROM lineitem GROUP BY 1, 2, 3), "
               "j AS (SELECT c.probe_id AS feature, c.value AS x, x.y FROM cells c JOIN x USING (probe_id, sample_id))")


def expression(spark, sf):
    return fx.read(spark, sf, "lineitem").groupBy(F.concat(F.lit("cg"), F.col("l_partkey")).alias("probe_id"), F.year("l_shipdate").cast("string").alias("sample_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("value"))


_FLAT = "HAVING count(*) >= 3 AND var_pop(x) > 1e-12 AND var_pop(y) > 1e-12"


@query("correlate_pearson", f"WITH {fx.CELLS}, {_EXPRESSION} SELECT feature, {r('corr(x, y)')} AS r, count(*) AS n FROM j GROUP BY 1 {_FLAT}")
def _(spark, sf):
    return _steady(spark, sf, "pearson").drop("pvalue")


@query("correlate_spearman", f"WITH {fx.CELLS}, {_EXPRESSION}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM j) "
       f"SELECT feature, {r('corr(rx, ry)')} AS r, count(*) AS n FROM k GROUP BY 1 {_FLAT}")
def _(spark, sf):
    return _steady(spark, sf, "spearman")


def _steady(spark, sf, method):
    """Correlations of features that vary on both sides."""
    cells, x = fx.cells(spark, sf), expression(spark, sf)
    some = lambda df: df.groupBy("probe_id").agg(F.var_pop("value").alias("v"), F.count("*").alias("n")).where("v > 1e-12 and n >= 3").select(F.col("probe_id").alias("feature"))
    out = enrich.correlate(cells, x, method).join(some(cells), "feature", "left_semi").join(some(x), "feature", "left_semi")
    return out if method == "pearson" else out.drop("pvalue")


@query("correlate_pvalues", f"WITH {fx.CELLS}, {_EXPRESSION}, c AS (SELECT feature, corr(x, y) AS r, count(*) AS n FROM j GROUP BY 1 {_FLAT}), t AS (SELECT *, abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300::DOUBLE)) AS t FROM c) "
       f"SELECT feature, {r('r')} AS r, {r(cf.t_pvalue('t', '(n - 2)'))} AS pvalue, n FROM t")
def _(spark, sf):
    return _steady(spark, sf, "pearson").select("feature", "r", "pvalue", "n")


_GRAM = ", ".join(f"sum(x{i} * x{j}) AS g_{i}_{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(x{i} * value) AS b_{i}" for i in range(3))


@query("cell_composition", f"WITH {fx.EMBEDDING}, x AS (SELECT probe_id, " + ", ".join(f"avg(value) FILTER (WHERE grp = '{i}') AS x{i}" for i in range(3)) + " FROM cells GROUP BY 1), "
       f"s AS (SELECT sample_id, {_GRAM} FROM cells JOIN x USING (probe_id) GROUP BY 1), w AS (SELECT sample_id, {cf.nnls3()} AS w FROM s), t AS (SELECT sample_id, unnest([0, 1, 2]) AS i, w, list_sum(w) AS total FROM w) "
       f"SELECT sample_id, CAST(i AS VARCHAR) AS cell_type, {r('CASE WHEN total > 0 THEN w[i + 1] / total ELSE 0 END')} AS proportion FROM t")
def _(spark, sf):
    cells = fx.embedding_cells(spark, sf)
    reference = cells.where(F.col("group").isin("0", "1", "2")).groupBy("probe_id", F.col("group").alias("cell_type")).agg(F.avg("value").alias("value"))
    return deconv.cell_composition(cells.select("probe_id", "sample_id", "value"), reference)


# Panels and models

@query("top_panel", f"{RES} SELECT probe_id, {r('pval')} AS pval FROM res ORDER BY pval, probe_id LIMIT 50")
def _(spark, sf):
    return signature.top_panel(fx.results(spark, sf), 50).select("probe_id", "pval")


@query("signature_forest")
def _(spark, sf):
    cells = fx.embedding_cells(spark, sf)
    labels = cells.select("sample_id", F.col("group").alias("label")).distinct()
    _, got = signature.model_signature(cells, labels, [f"d{i}" for i in range(64)], trees=20, n_splits=3)
    return spark.createDataFrame(sorted((k, float(v)) for k, v in got.items()), "metric string, value double")


# Tables for plots

@query("volcano", f"{RES} SELECT probe_id, {r('logFC')} AS \"logFC\", {r('-log10(greatest(pval, 2.2250738585072014e-308::DOUBLE))')} AS neg_log10_p, CASE WHEN pval < 0.1 AND logFC >= 0.5 THEN 'Hyper' WHEN pval < 0.1 AND logFC <= -0.5 THEN 'Hypo' ELSE 'NS' END AS class FROM res")
def _(spark, sf):
    return plotdata.volcano(fx.results(spark, sf), lfc_thresh=0.5, pval_thresh=0.1)


@query("qq_points", f"{RES}, o AS (SELECT pval, row_number() OVER (ORDER BY pval, probe_id) AS i, count(*) OVER () AS n FROM res) SELECT {r('-log10(1.0::DOUBLE / (n + 1) + (i - 1) * (1 - 2.0::DOUBLE / (n + 1)) / (n - 1))')} AS expected, {r('-log10(pval)')} AS observed FROM o")
def _(spark, sf):
    return plotdata.qq(fx.results(spark, sf))


@query("pvalue_histogram", f"{RES}, s AS (SELECT min(pval) AS lo, max(pval) AS hi, count(*) AS n FROM res), b AS (SELECT least(CAST(floor((pval - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS k FROM res, s GROUP BY 1) "
       f"SELECT CAST(j AS INTEGER) AS bin, {r('lo + j * (hi - lo) / 20')} AS low, {r('lo + (j + 1) * (hi - lo) / 20')} AS high, coalesce(k, 0) AS n, {r('n / 20.0::DOUBLE')} AS null_line FROM s CROSS JOIN range(0, 20) t(j) LEFT JOIN b ON bin = j")
def _(spark, sf):
    return plotdata.pvalue_histogram(fx.results(spark, sf), bins=20)


@query("manhattan", f"WITH {fx.results_sql()}, {fx.ANNOTATION}, o AS (SELECT chr, row_number() OVER (ORDER BY chr) - 1 AS i FROM (SELECT DISTINCT chr FROM ann)) SELECT probe_id, chr, i * 1000000000 + pos AS x, {r('-log10(pval)')} AS neg_log10_p FROM res JOIN ann USING (probe_id) JOIN o USING (chr)")
def _(spark, sf):
    return plotdata.manhattan(fx.results(spark, sf), fx.annotation(spark, sf))


@query("heatmap_zscores", f"WITH {fx.CELLS}, {fx.results_sql()}, t AS (SELECT probe_id FROM res ORDER BY pval, probe_id LIMIT 50), s AS (SELECT probe_id, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM cells JOIN t USING (probe_id) GROUP BY 1) "
       f"SELECT probe_id, sample_id, {r('(value - m) / CASE WHEN s > 1e-9 THEN s ELSE 1 END')} AS z FROM cells JOIN s USING (probe_id)")
def _(spark, sf):
    return plotdata.heatmap(fx.cells(spark, sf), fx.results(spark, sf))


@query("sample_summary", f"WITH {fx.CELLS} SELECT sample_id, {r('0.0')} AS missing_pct, {r('avg(value)')} AS mean, {r('var_samp(value)')} AS variance FROM cells GROUP BY 1")
def _(spark, sf):
    return plotdata.sample_summary(fx.cells(spark, sf))


@query("mean_variance", f"WITH {fx.CELLS} SELECT probe_id, {r('avg(value)')} AS mean, {r('var_samp(value)')} AS variance FROM cells GROUP BY 1")
def _(spark, sf):
    return plotdata.mean_variance(fx.cells(spark, sf))


@query("sample_correlation", f"WITH {fx.CELLS} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, {r('corr(a.value, b.value)')} AS r FROM cells a JOIN cells b ON a.probe_id = b.probe_id AND a.sample_id <= b.sample_id GROUP BY 1, 2")
def _(spark, sf):
    return plotdata.sample_correlation(fx.cells(spark, sf))


@query("mean_difference", f"{BASE}, {GROUPED}, d AS (SELECT probe_id, round(abs(avg(value) FILTER (WHERE grp = 'A') - avg(value) FILTER (WHERE grp = 'B')) + {NUDGE!r}::DOUBLE, {DIGITS}) AS d FROM rows_ GROUP BY 1) SELECT d AS difference FROM d WHERE d IS NOT NULL ORDER BY d DESC LIMIT 50")
def _(spark, sf):
    # Equal differences may differ in their last digit, so only the values are compared.
    return plotdata.mean_difference(fx.cells(spark, sf), groups(spark), "A", "B").select("difference")


@query("shrinkage_points", f"{RES} SELECT probe_id, {r('log10(s2 + 1e-12)')} AS log_s2, {r('log10(s2_post + 1e-12)')} AS log_s2_post FROM res")
def _(spark, sf):
    return plotdata.shrinkage(fx.results(spark, sf))


@query("expression_heatmap", f"WITH {fx.CELLS}, {_EXPRESSION}, c AS (SELECT feature, {r('abs(corr(x, y))')} AS strength FROM j GROUP BY 1 {_FLAT}) SELECT strength FROM c ORDER BY strength DESC LIMIT 50")
def _(spark, sf):
    # Equal correlations may differ in their last digit, so only their strengths are compared.
    return plotdata.expression_heatmap(_steady(spark, sf, "pearson")).select(F.abs("r").alias("strength"))


_PCA = (f"WITH RECURSIVE {fx.CELLS}, y AS (SELECT CAST(y AS VARCHAR) AS sample_id FROM range(1995, 2002) r(y)), m AS (SELECT probe_id, avg(value) AS m FROM cells GROUP BY 1), "
        "x AS (SELECT probe_id, sample_id, coalesce(value - m, 0) AS x FROM m CROSS JOIN y LEFT JOIN cells USING (probe_id, sample_id)), p_ AS (SELECT a.sample_id AS s, b.sample_id AS t, sum(a.x * b.x) AS g FROM x a JOIN x b USING (probe_id) GROUP BY 1, 2), "
        f"q_ AS (SELECT s, list(g ORDER BY t) AS g FROM p_ GROUP BY 1), g0 AS (SELECT list(g ORDER BY s) AS g FROM q_), {cf.principal('g0', 7, 1)}, {cf.deflated('g0', 7, 1)}, {cf.principal('g1', 7, 2)}, "
        "tr AS (SELECT list_sum(list_transform(range(1, 8), lambda i: g[i][i])) AS tr FROM g0)")


def _score(k: int) -> str:
    """A sample's score, the largest of all positive."""
    v = f"e{k}.v"
    return r(f"{v}[i] * sqrt(e{k}.value) * CASE WHEN list_max({v}) >= -list_min({v}) THEN 1 ELSE -1 END")


@query("pca_samples", f"{_PCA} SELECT CAST(1994 + i AS VARCHAR) AS sample_id, {_score(1)} AS pc1, {_score(2)} AS pc2, {r('e1.value / tr')} AS explained_1, {r('e2.value / tr')} AS explained_2 FROM e1, e2, tr, range(1, 8) t(i)")
def _(spark, sf):
    return plotdata.pca(model.pack(fx.cells(spark, sf), fx.YEARS), fx.YEARS)


#: Ward's distance from the clusters' means, whose products are means of the samples' products; the nearest two of all pairs are merged.
_MEAN = "list_sum(list_transform({0}, lambda p: list_sum(list_transform({1}, lambda q: g[p][q])))) / (len({0}) * len({1}))"
_WARD = ("w AS (SELECT 0 AS k, list_transform(range(1, 8), lambda i: [i]) AS c, NULL::DOUBLE AS distance, 0 AS size FROM g0 UNION ALL "
         "SELECT k + 1, list_append(list_filter(c, lambda x: NOT list_contains([c[best.i], c[best.j]], x)), list_concat(c[best.i], c[best.j])), sqrt(best.d), len(c[best.i]) + len(c[best.j]) "
         "FROM (SELECT k, c, list_sort(list_transform(list_filter(range(0, len(c) * len(c)), lambda x: x // len(c) < x % len(c)), lambda x: {'d': 2.0::DOUBLE * len(c[x // len(c) + 1]) * len(c[x % len(c) + 1]) / (len(c[x // len(c) + 1]) + len(c[x % len(c) + 1])) * ("
         + _MEAN.format("c[x // len(c) + 1]", "c[x // len(c) + 1]") + " + " + _MEAN.format("c[x % len(c) + 1]", "c[x % len(c) + 1]") + " - 2 * " + _MEAN.format("c[x // len(c) + 1]", "c[x % len(c) + 1]")
         + "), 'i': x // len(c) + 1, 'j': x % len(c) + 1}))[1] AS best FROM w, g0 WHERE len(c) > 1))")


@query("sample_linkage", f"{_PCA}, {_WARD} SELECT CAST(k - 1 AS INTEGER) AS step, {r('distance')} AS distance, CAST(size AS INTEGER) AS size FROM w WHERE k > 0")
def _(spark, sf):
    return plotdata.sample_linkage(packed(spark, sf), fx.YEARS).where("a is not null").select("step", "distance", "size")


# Sinks and planning

@query("export_columns", f"{RES} SELECT probe_id, {r('logFC')} AS \"logFC\", {r('pval')} AS pval, {r('padj')} AS padj FROM res")
def _(spark, sf):
    return result_columns(fx.results(spark, sf))


@query("sample_sheet_json", "SELECT CAST(y AS VARCHAR) AS sample_id, '{\"group\":\"' || CASE WHEN y <= 1997 THEN 'A' ELSE 'B' END || '\",\"batch\":' || (y % 2) || '}' AS json FROM range(1995, 2002) r(y)")
def _(spark, sf):
    return sample_sheet_json(fx.pheno(spark).drop("age"))


@query("plan_cost", "SELECT * FROM (VALUES ('platform:EPIC', 'per_sample', 20400.0::DOUBLE), ('dna_extraction', 'per_sample', 2160.0::DOUBLE), ('quality_control', 'per_sample', 1200.0::DOUBLE), ('bisulfite_conversion', 'per_sample', 1680.0::DOUBLE), "
       "('bioinformatics_array', 'per_sample', 3840.0::DOUBLE), ('dmr_analysis', 'fixed', 1500.0::DOUBLE)) t(component, unit, cost)")
def _(spark, sf):
    return planner.Plan().cost(spark, 48, "EPIC", include_optional=False)


@query("plan_timeline", "SELECT * FROM (VALUES ('study_design', 17.0::DOUBLE), ('ethics_irb', 54.0::DOUBLE), ('sample_collection', 72.0::DOUBLE), ('sample_processing', 33.0::DOUBLE), ('bisulfite_conversion', 11.0::DOUBLE), ('library_prep', 22.0::DOUBLE), "
       "('array_hybridization', 20.0::DOUBLE), ('sequencing_run', 11.0::DOUBLE), ('data_qc', 23.0::DOUBLE), ('statistical_analysis', 35.0::DOUBLE), ('validation', 17.0::DOUBLE), ('manuscript_prep', 36.0::DOUBLE), ('data_deposition', 14.0::DOUBLE), ('TOTAL', 310.0::DOUBLE)) t(phase_id, estimated_days)")
def _(spark, sf):
    return planner.Plan().timeline(spark, 200, "EPIC").select("phase_id", "estimated_days")


@query("plan_platforms", "SELECT * FROM (VALUES ('EPIC'), ('EPICv2'), ('Mouse_EPIC'), ('RRBS'), ('Targeted_BS')) t(id)")
def _(spark, sf):
    return planner.Plan().platforms(spark, recommended_only=True, most_cost=500).select("id")


#: The least whole number per group whose power is enough, by halving; a design's factor divides it before the power is taken.
_SIZES = ("WITH RECURSIVE d AS (SELECT * FROM (VALUES ('two_group', 2, false, 15, 1.0::DOUBLE), ('paired', 2, true, 12, 0.71::DOUBLE), ('multi_group', 3, false, 12, 1.15::DOUBLE)) t(design, n_groups, paired, least, factor)), "
          "c AS (SELECT * FROM d, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) e(effect), (VALUES ('fdr', 0.05::DOUBLE), ('bonferroni', 0.05::DOUBLE / 866895)) m(mcp, alpha)), "
          "s AS (SELECT 0 AS step, *, 1 AS lo, 500 AS hi FROM c UNION ALL SELECT step + 1, design, n_groups, paired, least, factor, effect, mcp, alpha, CASE WHEN power >= 0.8 THEN lo ELSE mid + 1 END, CASE WHEN power >= 0.8 THEN mid ELSE hi END "
          f"FROM (SELECT *, {cf.nct_tail('t', 'df', 'shift')} + 1 - {cf.nct_tail('(-t)', 'df', 'shift')} AS power FROM (SELECT *, {cf.t_critical('alpha', 'df')} AS t FROM (SELECT *, CASE WHEN paired THEN n - 1 ELSE 2 * n - 2 END AS df, "
          "effect * sqrt(CASE WHEN paired THEN n ELSE n / 2 END) AS shift FROM (SELECT *, greatest(mid / factor, 2.0001::DOUBLE) AS n FROM (SELECT *, (lo + hi) // 2 AS mid FROM s WHERE step < 9) q1) q2) q3) q4) q5)")


@query("plan_sample_sizes", f"{_SIZES} SELECT design, mcp, {r('effect')} AS effect, CAST(least(greatest(hi, least), 500) AS INTEGER) AS n_per_group, CAST(least(greatest(hi, least), 500) * n_groups AS INTEGER) AS total FROM s WHERE step = 9")
def _(spark, sf):
    plan = planner.Plan()
    rows = [plan.sample_size(d, "EPIC", e, mcp=m) for d in ("two_group", "paired", "multi_group") for e in (0.5, 0.8) for m in ("fdr", "bonferroni")]
    return spark.createDataFrame([(x["design_id"], x["mcp_method"], x["effect_size"], x["n_per_group"], x["total_samples"]) for x in rows], "design string, mcp string, effect double, n_per_group int, total int")
