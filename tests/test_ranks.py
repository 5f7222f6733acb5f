"""Exact quantiles and ranks by ranges, against plain sorting."""

import numpy as np
import pytest

from cytolake.operators import linmod, model, normalize, ranks, regions

RND = np.random.default_rng(4)
SHAPES = {
    "even": RND.random(30_001), "heavy": np.exp(RND.normal(size=20_000) * 6), "ties": RND.integers(0, 4, 20_000).astype(float),
    "mostly one": np.where(RND.random(20_000) < 0.9, 0.5, RND.random(20_000)), "two": np.array([3.0, 1.0]), "one": np.array([7.0]), "far": np.append(RND.normal(size=5000), [1e300, -1e300]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_equal_sorting(spark, shape):
    x = SHAPES[shape]
    rows = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(0, None), (0, float("nan"))], "g int, v double").repartition(5)
    for q in (0.0, 0.003, 0.25, 0.5, 0.999, 1.0):
        assert ranks.quantile(rows, "v", q).first()[0] == pytest.approx(np.quantile(x, q), rel=1e-12)
    got = {r.g: r.quantile for r in ranks.quantile(rows, "v", 0.5, ["g"]).collect()}
    assert got == {g: pytest.approx(np.median(x[g::3]), rel=1e-12) for g in range(3) if x[g::3].size}


def test_quantile_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "g int, v double")
    assert ranks.quantile(none, "v", 0.5).collect()[0][0] is None
    assert ranks.quantile(none, "v", 0.5, ["g"]).count() == 0


@pytest.mark.parametrize("shape", SHAPES)
def test_ranks_equal_sorting(spark, shape):
    x = SHAPES[shape][:3000]
    rows = spark.createDataFrame([(f"g{i % 2}", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double").repartition(3)
    got = {r.i: (r.rank, r.rank_of) for r in ranks.ranked(rows, "v", ["i"], ["g"], ranges=16).collect()}
    for g in range(2):
        own = list(range(g, x.size, 2))
        for k, i in enumerate(sorted(own, key=lambda i: (x[i], i)), 1):
            assert got[i] == (k, len(own))


def test_merging_regions_in_tiles(spark):
    """Tiles change nothing, whether regions are nested, chained over tiles or far apart."""
    rows = [("chr1", 0, 5000, 3), ("chr1", 100, 200, 3), ("chr1", 5100, 5200, 4), ("chr1", 9000, 9100, 3), ("chr1", 9150, 9900, 3), ("chr1", 20000, 20001, 5), ("chr2", 50, 60, 3)]
    df = spark.createDataFrame([(*r, None, float(i), 0.01, [str(i)]) for i, r in enumerate(rows)], "chr string, start long, end long, n_cpgs long, mean_delta_beta double, mean_logFC double, min_padj double, cpgs array<string>")
    want = None
    for tile in (1 << 22, 1000, 64):
        for mean in ("sequential", "weighted"):
            got = sorted((r.chr, r.start, r.end, r.n_cpgs, r.cpgs) for r in regions.merge_regions(df, 150, mean, tile).collect())
            want = want or got
            assert got == want
    assert [w[:4] for w in want] == [("chr1", 0, 5200, 10), ("chr1", 9000, 9900, 6), ("chr1", 20000, 20001, 5), ("chr2", 50, 60, 3)]


def test_batch_coefficients():
    """Least squares over present cells, row by row; Huber's weights resist an outlier."""
    x = np.column_stack([np.ones(12), np.arange(12) % 2, np.linspace(-1, 1, 12)])
    true = RND.normal(size=(20, 3))
    y = true @ x.T + RND.normal(size=(20, 12)) * 0.01
    holes = y.copy()
    holes[3, 2:4] = holes[7, 0] = np.nan
    got = normalize.batch_coefficients(holes, x, missing="ols")
    for i in range(20):
        ok = ~np.isnan(holes[i])
        assert np.allclose(got[i], np.linalg.lstsq(x[ok], holes[i, ok], rcond=None)[0])
    plain = normalize.batch_coefficients(holes, x)
    assert np.isnan(plain[[3, 7]]).all() and np.allclose(plain[0], got[0])
    y[:, 5] += 50
    bent, straight = (np.abs(normalize.batch_coefficients(y, x, robust=r) - true).max() for r in (True, False))
    assert bent < 0.2 < straight
    with pytest.raises(ValueError):
        normalize.batch_coefficients(y, x, missing="odd")


def test_release(spark):
    import pandas as pd

    cells = spark.createDataFrame([(f"p{i}", f"s{j}", float(RND.normal())) for i in range(30) for j in range(6)], "probe_id string, sample_id string, value double")
    x = pd.DataFrame({"intercept": np.ones(6), "g": [0.0, 0, 0, 1, 1, 1]})
    res = linmod.fit_differential(model.pack(cells, [f"s{j}" for j in range(6)]), x, contrast=[0, 1])
    assert res._fit.storageLevel.useMemory and res.count() == 30
    linmod.release(res)
    assert not res._fit.storageLevel.useMemory and res.count() == 30


def test_parametric_combat(spark):
    """Against the whole matrix at once, with a covariate; a probe with a missing cell and a constant one."""
    import pandas as pd

    n, names = 10, [f"s{i}" for i in range(10)]
    pheno = pd.DataFrame({"sample_id": names, "batch": list("aaaabbbccc"), "sex": list("mfmfmfmfmf")})
    shift, scale = {"a": 0.0, "b": 2.0, "c": -1.0}, {"a": 1.0, "b": 2.0, "c": 0.5}
    y = np.array([[RND.normal() * scale[b] + shift[b] * (1 + 0.1 * RND.normal()) + (s == "m") for b, s in zip(pheno.batch, pheno.sex)] for _ in range(60)])
    y[5, 2], y[6] = np.nan, 3.0
    cells = spark.createDataFrame([(f"p{i:02d}", names[j], None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(60) for j in range(n)], "probe_id string, sample_id string, value double")
    got = {r.probe_id: r["values"] for r in normalize.combat_parametric(model.pack(cells, names), pheno, "batch", ["sex"]).collect()}
    assert got["p05"] == [None] * n and got["p06"] == [3.0] * n
    keep = [i for i in range(60) if i not in (5, 6)]
    x = np.column_stack([(pheno.batch == b).astype(float) for b in "abc"] + [(pheno.sex == "m").astype(float)])
    beta = np.linalg.lstsq(x, y[keep].T, rcond=None)[0]
    sd = np.sqrt(((y[keep].T - x @ beta) ** 2).mean(axis=0))
    mean = (np.array([0.4, 0.3, 0.3]) @ beta[:3])[:, None] + np.outer(beta[3], x[:, 3])
    z = (y[keep] - mean) / sd[:, None]
    want = np.zeros_like(z)
    for k in range(3):
        of = x[:, k] == 1
        hat, var, m = z[:, of].mean(axis=1), z[:, of].var(axis=1, ddof=1), of.sum()
        a, b = (2 * var.var(ddof=1) + var.mean() ** 2) / var.var(ddof=1), (var.mean() * var.var(ddof=1) + var.mean() ** 3) / var.var(ddof=1)
        for i in range(len(keep)):
            g, d = hat[i], var[i]
            for _ in range(200):
                g = (hat.var(ddof=1) * m * hat[i] + d * hat.mean()) / (hat.var(ddof=1) * m + d)
                d = (0.5 * ((z[i, of] - g) ** 2).sum() + b) / (m / 2 + a - 1)
            want[i, of] = (z[i, of] - g) / np.sqrt(d)
    assert np.allclose([got[f"p{i:02d}"] for i in keep], want * sd[:, None] + mean, atol=1e-8)
    with pytest.raises(ValueError):
        normalize.combat_parametric(model.pack(cells, names), pheno.assign(batch=["z", *"aaaabbbcc"]), "batch")


def test_ward():
    """Against clusters' means at each step; leaves stand beside those that they are merged with."""
    from cytolake.operators import plotdata

    x = RND.normal(size=(12, 5))
    merged, leaves = plotdata.ward(((x[:, None] - x[None]) ** 2).sum(axis=2))
    members = {i: [i] for i in range(12)}
    for step, (a, b, d, size) in enumerate(merged):
        far = lambda p, q: np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(axis=0) - x[q].mean(axis=0))
        best = min(far(p, q) for i, p in members.items() for j, q in members.items() if i < j)
        assert d == pytest.approx(best) == pytest.approx(far(members[a], members[b])) and size == len(members[a]) + len(members[b])
        members[12 + step] = members.pop(a) + members.pop(b)
        own = sorted(leaves.index(i) for i in members[12 + step])
        assert own == list(range(own[0], own[0] + len(own)))
    assert sorted(leaves) == list(range(12)) and plotdata.ward(np.zeros((1, 1))) == ([], [0])
