"""Operators on small data: values, errors, and independence of partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytolake.operators import deconv, design, enrich, filters, genes, linmod, model, multitest, neighbours, normalize, planner, plotdata, regions, signature, summaries

S = [f"s{i}" for i in range(8)]


def matrix(spark, y, samples=S):
    rows = [(f"p{i:03d}", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(y)]
    return spark.createDataFrame(rows, "probe_id string, values array<double>")


def cells_of(spark, y, samples=S):
    return model.unpack(matrix(spark, y), samples)


@pytest.fixture(scope="module")
def y():
    rnd = np.random.default_rng(7)
    y = rnd.normal(size=(60, 8))
    y[:10, 4:] += 2
    return y


@pytest.fixture(scope="module")
def x():
    return design.build_design(pd.DataFrame({"group": list("AAAABBBB")}))


def test_design_and_contrasts(x):
    assert x.columns.tolist() == ["intercept", "group_B"] and x.dtypes.eq(float).all()
    wide = design.build_design(pd.DataFrame({"age": [1, 2, 3], "g": ["b", "a", "c"], "f": [True, False, True]}))
    assert wide.columns.tolist() == ["intercept", "age", "g_b", "g_c", "f_True"]
    assert design.contrast_vector(x, "ref-treat").tolist() == [0, -1] and design.contrast_vector(x, "B-A").tolist() == [0, 1]
    for bad in ([1, 0, 0], [0, 0]):
        with pytest.raises(ValueError):
            design.contrast_vector(x, bad)
    twin = x.assign(copy=x["group_B"])
    with pytest.raises(ValueError):
        design.contrast_vector(twin, [0, 1, 0])
    with pytest.raises(TypeError):
        design.build_design(pd.Series([1]))
    with pytest.raises(KeyError):
        design.check_alignment(["a", "a"], x.iloc[:2])
    with pytest.raises(ValueError):
        design.check_alignment(list("abcd"), x.iloc[2:6], paired_ids=[1, 1, 2, 2])
    design.check_alignment(list("abcd"), x.iloc[2:6], paired_ids=[1, 2, 1, 2])


@pytest.mark.parametrize("missing", [False, True])
def test_fit_equals_least_squares(spark, y, x, missing):
    y = y.copy()
    if missing:
        y[:20, 1], y[5:30, 6], y[59, :6] = np.nan, np.nan, np.nan
    got = linmod.fit_differential(matrix(spark, y), x, contrast=[0, 1], shrink="none", robust=False, residuals=True).toPandas().set_index("probe_id")
    assert len(got) == (59 if missing else 60)
    for i in range(59):
        ok = ~np.isnan(y[i])
        b, rss, rank, _ = np.linalg.lstsq(x.to_numpy()[ok], y[i, ok], rcond=None)
        r = got.loc[f"p{i:03d}"]
        assert (r.logFC, r.s2, r.n_obs) == (pytest.approx(b[1]), pytest.approx(rss[0] / (ok.sum() - 2)), ok.sum())
    assert (got.padj >= got.pval - 1e-12).all() and got.pval.between(0, 1).all()
    again = linmod.fit_differential(matrix(spark, y).repartition(7), x, contrast=[0, 1], shrink="none", robust=False).toPandas().set_index("probe_id")
    assert np.allclose(again.loc[got.index].padj, got.padj)


def test_priors(spark, y, x):
    for shrink, d0 in ((10.0, 10.0), (99.0, 50.0), ("median", 4.0), ("none", 0.0), ("auto", 0.0)):
        got = linmod.fit_differential(matrix(spark, y), x, contrast=[0, 1], shrink=shrink)
        assert {r.d0 for r in got.select("d0").collect()} == {d0}
    got = linmod.fit_differential(matrix(spark, y), x, shrink="smyth").toPandas()
    assert (got.d0 > 0).all() and (got.s2_post > 0).all() and "logFC" not in got
    assert linmod.solve_prior(0.0, 0.0, 5).df == linmod.FALLBACK_DF and linmod.solve_prior(0.0, None, 1).df == linmod.FALLBACK_DF
    for bad in ({"shrink": "odd"}, {"contrast_matrix": [[0, 1]]}, {"missing": "odd"}):
        with pytest.raises(ValueError):
            linmod.fit_differential(matrix(spark, y), x, contrast=[0, 1], **bad)
    with pytest.raises(ValueError):
        linmod.fit_differential(matrix(spark, y[:, :2]), x.iloc[3:5], contrast=[0, 1])
    with pytest.raises(ValueError):
        linmod.solve_prior(0.0, 1.0, 0)


def test_f_test_of_one_contrast_is_t_squared(spark, y, x):
    t = linmod.fit_differential(matrix(spark, y), x, contrast=[0, 1], shrink=5.0).toPandas().set_index("probe_id")
    f = linmod.fit_differential(matrix(spark, y), x, contrast_matrix=[[0, 1]], shrink=5.0).toPandas().set_index("probe_id").loc[t.index]
    assert np.allclose(f.F, t.t**2) and np.allclose(f.pval, t.pval, rtol=1e-6)


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("how", ["ols", "reference"])
def test_fit_of_groups_is_the_fit_of_their_design(spark, y, missing, how):
    y, groups = y.copy(), list("AABBBCCC")
    if missing:
        y[:20, 1], y[5:30, 6], y[40:45, 2:5], y[45:50, :2], y[58], y[59, :6] = np.nan, np.nan, np.nan, np.nan, 1.0, np.nan
    x = design.build_design(pd.DataFrame({"group": groups}))
    want = linmod.fit_differential(matrix(spark, y), x, contrast_matrix=np.eye(3)[1:], shrink="smyth", missing=how).toPandas().set_index("probe_id")
    samples = spark.createDataFrame(list(zip(S, groups)), "sample_id string, group string")
    got = linmod.fit_groups(cells_of(spark, y).join(samples, "sample_id"), samples, shrink="smyth", missing=how).toPandas().set_index("probe_id")
    assert sorted(got.index) == sorted(want.index) and len(got) == (58 if missing else 60)
    for c in ("s2", "n_obs", "df_resid", "s2_post", "F", "df1", "df2", "pval", "padj"):
        assert np.allclose(got.loc[want.index, c], want[c], rtol=1e-9, atol=1e-12), c
    with pytest.raises(KeyError):
        linmod.fit_groups(cells_of(spark, y).join(samples, "sample_id"), samples.union(samples))
    with pytest.raises(ValueError):
        linmod.fit_groups(cells_of(spark, y).withColumn("group", F.lit("A")), samples.withColumn("group", F.lit("A")))


def test_fit_of_groups_takes_many_samples(spark):
    """Of 120 000 samples, no list, literal or row is made."""
    n, k = 120_000, 10
    cells = spark.range(n).select(F.explode(F.array(F.lit("p0"), F.lit("p1"), F.lit("p2"))).alias("probe_id"), F.col("id").cast("string").alias("sample_id"),
                                  ((F.col("id") * 7919 % 10007) / 10007.0 + F.when(F.col("probe_id") == "p1", F.col("id") % k / 100.0).otherwise(0.0)).alias("value"), (F.col("id") % k).cast("string").alias("group"))
    got = linmod.fit_groups(cells, cells.select("sample_id", "group").distinct(), shrink="none").toPandas().set_index("probe_id")
    i = np.arange(n)
    for probe, add in (("p0", 0.0), ("p1", i % k / 100), ("p2", 0.0)):
        v = i * 7919 % 10007 / 10007 + add
        z = np.clip(v, *np.quantile(v, [0.05, 0.95]))
        means = np.array([v[i % k == g].mean() for g in range(k)])
        s2 = ((z - means[i % k]) ** 2).sum() / (n - k)
        assert (got.loc[probe].s2, got.loc[probe].F) == (pytest.approx(s2, rel=1e-9), pytest.approx((n / k * (means - v.mean()) ** 2).sum() / (k - 1) / s2, rel=1e-6))


def test_constant_and_sparse_probes_are_left_out(spark, x):
    y = np.vstack([np.ones(8), [1, np.nan, np.nan, np.nan, 2, np.nan, np.nan, np.nan], np.arange(8.0)])
    assert [r.probe_id for r in linmod.fit_differential(matrix(spark, y), x, contrast=[0, 1], shrink="none").collect()] == ["p002"]


@pytest.mark.parametrize("method", multitest.METHODS)
def test_adjustment(spark, method):
    rnd = np.random.default_rng(1)
    p = np.concatenate([rnd.uniform(size=300) ** 3, [0.5] * 50, [0.0, 1.0, 1.0, 1e-200]])
    got = multitest.adjust(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(-1, None), (-2, float("nan"))], "i int, p double"), "p", "q", method).toPandas().set_index("i")
    assert got.loc[[-1, -2]].q.isna().all() and len(got) == p.size + 2
    order, m = np.argsort(p, kind="stable"), p.size
    i, s = np.arange(1, m + 1), p[order]
    bh = np.minimum.accumulate((s * m / i)[::-1])[::-1]
    want = {"none": s, "bonferroni": s * m, "sidak": 1 - (1 - s) ** m, "holm": np.maximum.accumulate(s * (m - i + 1)), "holm-sidak": np.maximum.accumulate(1 - (1 - s) ** (m - i + 1)),
            "simes-hochberg": np.minimum.accumulate((s * (m - i + 1))[::-1])[::-1], "fdr_bh": bh, "fdr_by": bh * (1 / i).sum()}[method]
    assert np.allclose(got.loc[order].q, np.minimum(want, 1), atol=1e-12)
    with pytest.raises(ValueError):
        multitest.adjust(got, "p", method="odd")


def test_stouffer(spark):
    r = multitest.stouffer(spark.createDataFrame([(0.01,), (0.02,), (0.05,)], "p double"), "p").first()
    assert r.z == pytest.approx((2.3263479 + 2.0537489 + 1.6448536) / 3**0.5) and r.pvalue == pytest.approx(0.0002521, abs=1e-6)


def test_quantile_normalisation_gives_equal_distributions(spark, y):
    y = y.copy()
    y[3, 2] = np.nan
    got = model.wide_from_cells(normalize.quantile_normalized(cells_of(spark, y)), S).toPandas().set_index("probe_id")
    assert np.isnan(got.loc["p003", "s2"]) and np.allclose(np.sort(got["s0"]), np.sort(got["s1"]))
    with pytest.raises(ValueError):
        normalize.normalize(model.Study(cells_of(spark, y), spark.createDataFrame([(s,) for s in S], "sample_id string")), "odd")


def test_conversion_round_trip(spark):
    beta = spark.createDataFrame([("a", "s", 0.25), ("b", "s", 0.0), ("c", "s", None)], "probe_id string, sample_id string, value double")
    study = normalize.convert(normalize.convert(model.Study(beta, beta.select("sample_id")), "M"), "beta")
    assert {r.probe_id: r.value for r in study.cells.collect()} == {"a": pytest.approx(0.25), "b": pytest.approx(1e-6), "c": None}
    with pytest.raises(ValueError):
        normalize.convert(study, "odd")


def test_batch_correction(spark, y):
    pheno = pd.DataFrame({"batch": list("ABABABAB"), "age": np.arange(8.0)})
    got = np.array([r["values"] for r in normalize.batch_corrected(matrix(spark, y), pheno, "batch", ["age"]).orderBy("probe_id").collect()])
    x, of_batch = normalize.batch_design(pheno, "batch", ["age"])
    b = np.linalg.lstsq(x, y.T, rcond=None)[0]
    assert np.allclose(got, y - (x[:, of_batch] @ b[of_batch]).T)
    assert normalize.batch_corrected(matrix(spark, y), pheno.assign(batch="A"), "batch").first()["values"] == pytest.approx(y[0].tolist())
    with pytest.raises(ValueError):
        normalize.batch_design(pheno.assign(age=[np.nan] * 8), "batch", ["age"])
    with pytest.raises(KeyError):
        normalize.batch_design(pheno, "batch", ["sex"])
    hole = y.copy()
    hole[0, 0] = np.nan
    assert normalize.batch_corrected(matrix(spark, hole), pheno, "batch").orderBy("probe_id").first()["values"] == [None] * 8


def test_filters(spark, y):
    y = y.copy()
    y[:, 0] = np.nan
    y[0, :5] = np.nan
    cells = cells_of(spark, y)
    study = model.Study(cells, spark.createDataFrame([(s, "AB"[i > 3]) for i, s in enumerate(S)], "sample_id string, group string"))
    clean = filters.qc_samples(study)
    assert clean.meta["qc"]["flagged_samples"] == ["s0"] and clean.cells.select("sample_id").distinct().count() == 7
    assert filters.qc_probes(clean).cells.select("probe_id").distinct().count() == 59
    groups = study.pheno
    assert filters.filter_missingness(cells, 8, 0.2).select("probe_id").distinct().count() == 59
    assert filters.filter_missingness(cells, 8, 1.0, 4, groups).count() == 0
    assert filters.filter_min_per_group(cells, groups, 4).select("probe_id").distinct().count() == 59
    assert filters.filter_low_variance(cells, 50.0).select("probe_id").distinct().count() == 30
    with pytest.raises(ValueError):
        filters.filter_missingness(cells, 8, 2.0)
    with pytest.raises(ValueError):
        filters.impute(cells, "odd")


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(40, 8))
    x[1, 2], x[5, 0], x[7, 7], x[7, 6] = np.nan, np.nan, np.nan, np.nan
    want = neighbours.impute_matrix(x, 3)
    got = np.array([r["values"] for r in neighbours.impute_probes(matrix(spark, x), 8, 3, blocks=3).orderBy("probe_id").collect()])
    assert np.allclose(got, want)
    samples = np.array([r["values"] for r in neighbours.impute_samples(matrix(spark, x), 8, 2).orderBy("probe_id").collect()])
    assert not np.isnan(samples).any() and np.allclose(samples[~np.isnan(x)], x[~np.isnan(x)])
    d = neighbours.distances(x.T, x.T)
    near = [j for j in np.argsort(d[2]) if j != 2 and not np.isnan(x[1, j])][:2]
    assert samples[1, 2] == pytest.approx((x[1, near] / d[2, near]).sum() / (1 / d[2, near]).sum())


def test_results_tables(spark):
    res = spark.createDataFrame([("a", 2.0, 0.0005, 0.001), ("b", -2.5, 0.001, 0.002), ("c", 1.5, 0.002, 0.003), ("d", -0.2, 0.2, 0.3), ("e", None, None, None)], "probe_id string, logFC double, pval double, padj double")
    res = res.withColumn("s2", F.lit(1.0)).withColumn("s2_post", F.lit(0.5)).withColumn("d0", F.lit(4.0))
    ids = lambda df: sorted(r.probe_id for r in df.collect())
    assert ids(summaries.filter_dms(res, lfc_thresh=1.0, direction="hyper")) == ["a", "c"] and ids(summaries.filter_dms(res, lfc_thresh=1.0, direction="hypo")) == ["b"]
    assert ids(summaries.filter_dms(res, pval_thresh=0.3)) == ["a", "b", "c", "d"] and ids(summaries.significant(res, pval_thresh=0.3)) == ["a", "b", "c"]
    r = summaries.summarize_results(res).first()
    assert (r.total_tested, r.significant, r.hypermethylated, r.hypomethylated, r.shrinkage_factor) == (5, 3, 2, 1, 0.5)
    assert summaries.summarize_results(res.limit(0)).first().total_tested == 0
    with pytest.raises(ValueError):
        summaries.summarize_results(res, 0)
    with pytest.raises(KeyError):
        summaries.filter_dms(res, pval="odd")
    two = summaries.reproducibility(res, res).first()
    assert (two.n_overlap, two.jaccard, two.n_sig_overlap, two.spearman) == (5, 1.0, 3, pytest.approx(1.0))
    assert [r.probe_id for r in signature.top_panel(res, 2).collect()] == ["a", "b"]
    assert [r.probe_id for r in signature.top_panel(res.drop("pval"), 1, importance="logFC").collect()] == ["a"]


def test_regions(spark):
    dms = spark.createDataFrame([("a", 2.0, 0.001), ("b", 2.1, 0.002), ("c", 2.2, 0.003), ("d", 0.5, 0.3)], "probe_id string, logFC double, padj double")
    ann = spark.createDataFrame([("a", "1", 1000), ("b", "chr1", 1100), ("c", "CHR1", 1200), ("d", "2", 5000)], "probe_id string, chr string, pos int")
    got = regions.find_regions(dms, ann, max_gap=500, min_cpgs=2).collect()
    assert [(r.chr, r.start, r.end, r.n_cpgs, r.cpgs) for r in got] == [("chr1", 1000, 1200, 3, ["a", "b", "c"])]
    assert regions.summarize_regions(regions.find_regions(dms.limit(0), ann)).first().n_regions == 0
    sites = spark.createDataFrame([("chr1", p, f"p{p}") for p in (1, 5, 9, 30, 34, 70, 71, 1000)], "chr string, pos bigint, probe_id string")
    for tile in (7, 1 << 22):
        assert sorted((r.pos, r.cluster) for r in regions.clusters(sites, 5, tile).collect()) == [(1, 1), (5, 1), (9, 1), (30, 30), (34, 30), (70, 70), (71, 70), (1000, 1000)]
    parts = spark.createDataFrame([("chr1", 0, 10, 2, 0.1, 1.0, 0.01, ["a"]), ("chr1", 20, 30, 4, 0.3, None, 0.02, ["b"]), ("chr1", 35, 40, 2, 0.5, 3.0, 0.03, ["c"]), ("chr1", 90, 99, 2, 0.7, 4.0, 0.04, ["d"])],
                                  "chr string, start bigint, end bigint, n_cpgs bigint, mean_delta_beta double, mean_logFC double, min_padj double, cpgs array<string>")
    first = sorted(regions.merge_regions(parts, 12).collect(), key=lambda r: r.start)[0]
    assert (first.end, first.n_cpgs, first.mean_delta_beta, first.mean_logFC, first.cpgs) == (40, 8, pytest.approx(0.35), pytest.approx(2.0), ["a", "b", "c"])
    assert sorted(regions.merge_regions(parts, 12, "weighted").collect(), key=lambda r: r.start)[0].mean_logFC == pytest.approx(2.0)


def test_genes_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    gene = [(i, f"chr{rnd.integers(1, 3)}", int(s), int(s + rnd.integers(1, 400_000)), f"g{i}", "+-"[int(rnd.integers(2))]) for i, s in enumerate(rnd.integers(0, 10**7, 40))]
    site = [(f"p{i}", f"chr{rnd.integers(1, 4)}", int(rnd.integers(0, 1.2e7))) for i in range(300)]
    got = genes.map_to_genes(spark.createDataFrame(site, "probe_id string, chr string, pos bigint"), spark.createDataFrame(gene, "gene_ord bigint, chr string, start bigint, end bigint, gene_symbol string, strand string"), max_distance=300_000).collect()
    by = {r.probe_id: r for r in got}
    assert len(got) == 300
    for p, c, pos in site:
        near = sorted((max(s - pos, pos - e, 0), i, g) for i, ch, s, e, g, _ in gene if ch == c)
        r = by[p]
        if not near:
            assert r.relation is None and r.nearest_gene is None
        elif near[0][0] > 300_000:
            assert (r.relation, r.nearest_gene, r.distance_bp) == ("intergenic", None, None)
        else:
            assert r.nearest_gene == near[0][2] and (r.relation == "gene_body") == (near[0][0] == 0)


def test_gene_examples_and_relation(spark):
    dms = spark.createDataFrame([("a", "chr1", 1000), ("b", "2", 2000)], "probe_id string, chr string, pos bigint")
    g = spark.createDataFrame([(0, "chr1", 500, 1500, "G1"), (1, "chr2", 1500, 2500, "G2")], "gene_ord bigint, chr string, start bigint, end bigint, gene_symbol string")
    assert sorted((r.nearest_gene, r.relation, r.distance_bp) for r in genes.map_to_genes(dms, g).collect()) == [("G1", "gene_body", 0), ("G2", "gene_body", 0)]
    cases = [(9900, "+", "proximal_promoter"), (9000, "+", "distal_promoter"), (6000, "+", "distal_upstream"), (4000, "+", "intergenic"), (20100, "-", "proximal_promoter"), (19999, "-", "gene_body"), (9900, "-", "intergenic")]
    df = spark.createDataFrame([(p, s, w) for p, s, w in cases], "p bigint, s string, w string")
    assert all(r.got == r.w for r in df.select("w", genes.relation(F.col("p"), F.lit(10_000), F.lit(20_000), F.col("s"))["relation"].alias("got")).collect())


def test_liftover_of_a_chain(spark):
    lines = ["chain 10 chr1 1000 + 100 300 chr2 5000 + 1000 1210 1", "50 10 20", "140", "", "chain 5 chr3 1000 + 0 100 chr3 900 - 0 100 2", "100"]
    blocks = genes.chain_blocks(lines)
    assert blocks[0] == ("chr1", 100, 150, "chr2", 1000, 5000, "+") and blocks[1][1:3] == (160, 300) and blocks[1][4] == 1070
    df = spark.createDataFrame(blocks, "chr string, start bigint, end bigint, to_chr string, to_start bigint, to_size bigint, to_strand string")
    r = spark.createDataFrame([("a", "1", 110, 170), ("b", "chr1", 152, 170), ("c", "chr3", 10, 20)], "name string, chr string, start bigint, end bigint")
    got = {x.name: (x.chr, x.start, x.end, x.lifted) for x in genes.liftover(r, df).collect()}
    assert got == {"a": ("chr2", 1010, 1080, True), "b": (None, None, None, False), "c": ("chr3", 879, 889, True)}


def test_enrichment_and_pathways(spark):
    sets = spark.createDataFrame([("t", f"g{i}") for i in range(6)] + [("u", f"g{i}") for i in range(4, 14)] + [("small", "g1")], "term string, gene string")
    got = {r.term: r for r in enrich.enrichment(spark.createDataFrame([(f"g{i}",) for i in range(4)], "gene string"), sets, cutoff=None).collect()}
    assert set(got) == {"t", "u"} and got["t"].overlap == 4 and got["u"].pvalue == pytest.approx(1.0) and got["t"].pvalue == pytest.approx(15 / 1001)
    assert enrich.enrichment(spark.createDataFrame([("x",)], "gene string"), sets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        enrich.pathway_scores(sets, sets, sets, "odd")


def test_correlation(spark, y):
    a, b = cells_of(spark, y), cells_of(spark, y * 2 + np.random.default_rng(0).normal(size=y.shape))
    got = {r.feature: r for r in enrich.correlate(a, b).collect()}
    assert len(got) == 60 and all(-1 <= r.r <= 1 and 0 <= r.pvalue <= 1 for r in got.values())
    rank = {r.feature: r.r for r in enrich.correlate(a, a, "spearman").collect()}
    assert all(v == pytest.approx(1) for v in rank.values())
    assert enrich.correlate(a, b.limit(0)).count() == 0


def test_composition(spark):
    rnd = np.random.default_rng(5)
    ref, w = rnd.uniform(size=(60, 3)), np.array([[0.2, 0.3, 0.5], [1, 0, 0], [0, 0.6, 0.4]])
    bulk = cells_of(spark, ref @ w.T, ["a", "b", "c"])
    reference = spark.createDataFrame([(f"p{i:03d}", "xyz"[j], float(ref[i, j])) for i in range(60) for j in range(3)], "probe_id string, cell_type string, value double")
    got = deconv.cell_composition(bulk, reference).toPandas().pivot(index="sample_id", columns="cell_type", values="proportion")
    assert np.allclose(got.to_numpy(), w, atol=1e-8)
    with pytest.raises(ValueError):
        deconv.cell_composition(bulk.withColumn("probe_id", F.lit("q")), reference)
    g = rnd.normal(size=(9, 4))
    b = rnd.normal(size=9)
    sol = deconv.nnls(g.T @ g, g.T @ b)
    slope = g.T @ (g @ sol - b)
    assert (sol >= 0).all() and (slope > -1e-8).all() and abs(slope @ sol) < 1e-8


def test_signatures(spark):
    rnd = np.random.default_rng(6)
    y = rnd.normal(size=(4, 40))
    y[0, :20] += 3
    names = [f"s{i:02d}" for i in range(40)]
    cells = cells_of(spark, y, names)
    labels = spark.createDataFrame([(s, "ab"[i < 20]) for i, s in enumerate(names)], "sample_id string, label string")
    _, got = signature.model_signature(cells, labels, ["p000", "p001"], "elasticnet", n_splits=3)
    assert got["cv_auc"] > 0.9 and got["train_accuracy"] > 0.9
    assert signature.validate_signature(cells, labels, cells, labels, ["p000"])["auc"] > 0.9
    assert signature.infer_task(labels) == "classification" and signature.infer_task(spark.range(40).select(F.col("id").alias("label"))) == "regression"
    with pytest.raises(ValueError):
        signature.model_signature(cells, labels, ["p000"], "odd")


def test_plans(spark, tmp_path):
    plan = planner.Plan()
    assert plan.with_regional_pricing(1.2).platform("EPIC")["cost_per_sample"] == round(425 * 1.2, 2) and plan.platform("EPIC")["cost_per_sample"] == 425
    with pytest.raises(KeyError):
        plan.platform("odd")
    for bad in (lambda: plan.with_platform_cost("EPIC", -1), lambda: plan.with_platform("EPIC", {}), lambda: plan.with_regional_pricing(0), lambda: plan.cost(spark, 0, "EPIC"), lambda: plan.with_platform("new", {"n_cpgs": 0})):
        with pytest.raises(ValueError):
            bad()
    for name in ("p.json", "p.yaml"):
        path = str(tmp_path / name)
        plan.with_platform_cost("EPIC", 1.5).save(path)
        assert planner.Plan.load(path).platform("EPIC")["cost_per_sample"] == 1.5
    (tmp_path / "p.csv").write_text("platform_id,name,n_cpgs,cost_per_sample,processing_days\nX,Test,1000,100,5\n")
    assert planner.Plan.load(str(tmp_path / "p.csv")).platform("X")["n_cpgs"] == 1000
    assert plan.total_cost(spark, 10, "EPIC", False).first().total_cost == 10 * (425 + 45 + 25 + 35 + 80) + 1500
    assert plan.sample_size("two_group", "EPIC", 0.5)["n_per_group"] == 64 and plan.sample_size("two_group", "EPIC", 0.0)["n_per_group"] == 15
    assert plan.components(spark, "WGBS").where("id = 'sequencing_novaseq'").count() == 1


def test_plot_tables(spark, y):
    cells = cells_of(spark, y)
    got = plotdata.pca(model.pack(cells, S), S).toPandas().set_index("sample_id")
    z = y - y.mean(axis=1, keepdims=True)
    v = np.linalg.svd(z, full_matrices=False)[1]
    assert np.allclose(np.abs(got["pc1"]).sum(), np.abs(np.linalg.svd(z, full_matrices=False)[2][0] * v[0]).sum())
    assert got["explained_1"].iloc[0] == pytest.approx(v[0] ** 2 / (v**2).sum())
    r = plotdata.sample_correlation(cells).where("sample_a = 's0' and sample_b = 's1'").first().r
    assert r == pytest.approx(np.corrcoef(y[:, 0], y[:, 1])[0, 1])
    with pytest.raises(RuntimeError):
        plotdata.expression_heatmap(spark.createDataFrame([], "feature string, r double"))
