"""Axes and null spectra against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispersa.operators import spectra
from dispersa.operators.resampling import bootstrap_weights


def symmetric(p, seed, rank=3):
    rng = np.random.Generator(np.random.Philox(seed))
    v = rng.normal(size=(p, rank))
    m = (v * np.array([3.0, -2.0, 1.0])[:rank]) @ v.T / p + rng.normal(size=(p, p)) * 0.05
    return (m + m.T) / 2


def table(spark, m):
    n = [f"f{i:03d}" for i in range(len(m))]
    return spark.createDataFrame([(n[i], n[j], float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m))], "i string, j string, r double")


@pytest.mark.parametrize(("p", "side"), [(60, 512), (60, 16), (130, 40), (5, 2)])
def test_axes_equal_a_dense_decomposition(spark, p, side):
    m = symmetric(p, p)
    np.fill_diagonal(m, 0.5)
    got = spectra.leading_axes(table(spark, m), "r", 4, diagonal=0.5, side=side).collect()
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:4]
    for rank, c in enumerate(order, 1):
        own = sorted((r.feature, r.v, r.eigenvalue, r.share) for r in got if r["rank"] == rank)
        assert len(own) == p and own[0][2] == pytest.approx(values[c], abs=1e-8) and own[0][3] == pytest.approx(values[c] ** 2 / (m**2).sum(), abs=1e-8)
        v = np.array([x[1] for x in own])
        assert v[np.abs(v).argmax()] > 0 and abs(v @ vectors[:, c]) == pytest.approx(1, abs=1e-4)


def test_share_of_a_low_rank_fit(spark):
    m = symmetric(40, 9)
    np.fill_diagonal(m, 0.0)
    pairs = table(spark, m)
    axes = spectra.leading_axes(pairs, "r", 3)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))
    up = np.triu_indices(40, 1)
    for k in (1, 3):
        back = (vectors[:, order[:k]] * values[order[:k]]) @ vectors[:, order[:k]].T
        assert spectra.rank_fit(pairs, "r", axes, k).first().r2 == pytest.approx(np.corrcoef(m[up], back[up])[0, 1] ** 2, abs=1e-6)


def shrunk(x):
    """Shrunken correlation of a units x features matrix and its lambda, pair by pair."""
    n = len(x)
    s = x.std(0, ddof=1)
    z = np.where(s > 0, (x - x.mean(0)) / np.where(s > 0, s, 1), 0.0)
    r = z.T @ z / (n - 1)
    up = np.triu_indices(x.shape[1], 1)
    w = z[:, up[0]] * z[:, up[1]]
    num = (n / (n - 1) ** 3 * ((w - w.mean(0)) ** 2).sum(0)).sum()
    lam = min(1, max(0, num / (r[up] ** 2).sum()))
    r = r * (1 - lam)
    np.fill_diagonal(r, 1.0)
    return r, lam


@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.Generator(np.random.Philox(12))
    p, sizes = 60, {"MIX.SC": 70, "MIX.SE": 50, "HYB.SC": 80, "HYB.SE": 80}
    data = {}
    for k, (d, n) in enumerate(sizes.items()):
        data[d] = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) * rng.normal(size=p) * (0.4 + 0.2 * k)
    data["MIX.SC"][:, 3] = 0.0
    names = [f"f{i:02d}" for i in range(p)]
    rows = [(d, f"u{u:03d}", names[i], float(x[u, i])) for d, x in data.items() for u in range(len(x)) for i in range(p)]
    return data, spark.createDataFrame(rows, "dataset string, unit string, feature string, r double")


@pytest.mark.parametrize("side", [512, 25])
def test_permutation_spectra(spark, views, side, monkeypatch):
    data, residuals = views
    monkeypatch.setattr(spectra, "UNITS_TOGETHER", 60)
    parents = tuple(spectra.unit_vectors(residuals, [v]) for v in ("MIX.SC", "MIX.SE"))
    units = spectra.relabelled_units(parents, spectra.unit_vectors(residuals, ["HYB.SC", "HYB.SE"]), 9, 5)
    got = {(r.draw, r.part, r["rank"]): r.value for r in spectra.spectra(spectra.null_blocks(units, side), 6).collect()}
    assert len(got) == 10 * 3 * 6
    labels = {(r.grp, r.db, r.unit): r.flags for r in units.collect()}
    halves = []
    for draw in range(10):
        db, i = divmod(draw, spectra.DRAWS_TOGETHER)
        f = {u: x[i] for (g, b, u), x in labels.items() if g == 0 and b == db}
        s = {u: x[i] for (g, b, u), x in labels.items() if g == 1 and b == db}
        assert sum(f.values()) == 70 and len(f) == 120 and len(s) == 80
        pool = [(f[f"{str(d == 'MIX.SC').lower()}:u{u:03d}"], data[d][u]) for d in ("MIX.SC", "MIX.SE") for u in range(len(data[d]))]
        a, b = np.stack([x for k, x in pool if k]), np.stack([x for k, x in pool if not k])
        swap = np.array([s[f"u{u:03d}"] for u in range(80)])[:, None]
        c, e = np.where(swap, data["HYB.SE"], data["HYB.SC"]), np.where(swap, data["HYB.SC"], data["HYB.SE"])
        total, cis = shrunk(a)[0] - shrunk(b)[0], shrunk(c)[0] - shrunk(e)[0]
        for part, m in (("total", total), ("cis", cis), ("trans", total - cis)):
            want = np.sort(np.linalg.eigvalsh(m) ** 2)[::-1][:6]
            assert np.allclose([got[draw, part, k] for k in range(1, 7)], want, rtol=1e-5, atol=1e-10)
        halves.append(tuple(sorted(u for u, x in f.items() if x)))
    assert len(set(halves)) == 10 and all(k.startswith("true") for k in halves[0])


def test_recoloured_units_have_the_pooled_correlation(spark, views):
    data, residuals = views
    rng = np.random.Generator(np.random.Philox(3))
    keep = [f"f{i:02d}" for i in range(20, 40)]
    some = residuals.where(F.col("feature").isin(keep))
    parent, hybrid = (spectra.unit_vectors(some, [v]) for v in ("MIX.SC", "HYB.SC"))
    f = rng.uniform(0.8, 1.0, 20)
    p, h, figures = spectra.recoloured(parent, hybrid, f.tolist())
    x, y = data["MIX.SC"][:, 20:40], data["HYB.SC"][:, 20:40]
    (sx, lx), (sy, ly) = shrunk(x), shrunk(y)
    assert (figures["lambda_parent"], figures["lambda_hybrid"]) == pytest.approx((lx, ly))
    scaled = sy * np.outer(f, f)
    np.fill_diagonal(scaled, 1.0)
    target = (70 * sx + 80 * scaled) / 150
    new_p, new_h = (np.stack([r.x0 for r in df.collect()]) for df in (p, h))
    assert np.allclose(np.corrcoef(new_p.T), target, atol=1e-8)
    if figures["raised"] == 0:
        back = np.corrcoef(new_h.T) * np.outer(f, f)
        np.fill_diagonal(back, 1.0)
        assert np.allclose(back, target, atol=1e-8)
    draws = [(d, g, f"u{u:03d}", int(w)) for d in (1, 2) for g, n in ((0, 70), (1, 80)) for u, w in enumerate(np.bincount(rng.integers(0, n, n), minlength=n)) if w]
    got = {(r.draw, r["rank"]): r.value for r in spectra.recoloured_spectra(p, h, spark.createDataFrame(draws, "draw int, grp int, unit string, w long"), f.tolist(), 5).collect()}
    at = {g: {r.unit: np.array(r.x0) for r in df.collect()} for g, df in ((0, p), (1, h))}
    for d in (1, 2):
        a, b = (np.stack([at[g][u] for dd, gg, u, w in draws if dd == d and gg == g for _ in range(w)]) for g in (0, 1))
        m = shrunk(b)[0] * np.outer(f, f)
        np.fill_diagonal(m, 1.0)
        want = np.sort(np.linalg.eigvalsh(m - shrunk(a)[0]) ** 2)[::-1][:5]
        assert np.allclose([got[d, k] for k in range(1, 6)], want, rtol=1e-6)


def test_recoloured_spectra_by_hash_need_no_table_of_draws(spark, monkeypatch):
    monkeypatch.setattr(spectra, "UNITS_TOGETHER", 16)
    monkeypatch.setattr(spectra, "PRODUCT_BYTES", 4 * 11 * 12 * 3)  # three draws and 16 units a task
    rng = np.random.Generator(np.random.Philox(8))
    sizes = (70, 45)
    x = [rng.normal(size=(n, 5)) + rng.normal(size=(n, 1)) for n in sizes]
    groups = [spark.createDataFrame([(f"u{i:03d}", [float(v) for v in r]) for i, r in enumerate(m)], "unit string, x0 array<double>") for m in x]
    place = [rng.permutation(n) for n in sizes]
    placed = spark.createDataFrame([(g, f"u{i:03d}", int(place[g][i]), n) for g, n in enumerate(sizes) for i in range(n)], "grp int, unit string, pos long, n long")
    f = [0.8, 0.9, 1.0, 0.95, 0.7]
    got = {(r.draw, r["rank"]): r.value for r in spectra.hashed_recoloured_spectra(*groups, placed, 7, 2, f, 5).collect()}
    weights = bootstrap_weights(spark.createDataFrame(list(enumerate(sizes)), "stratum int, n long"), 7, 2).withColumnRenamed("stratum", "grp").join(placed, ["grp", "pos"])
    want = {(r.draw, r["rank"]): r.value for r in spectra.recoloured_spectra(*groups, weights.select("draw", "grp", "unit", "w"), f, 5).collect()}
    assert len(got) == 35 and set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-8, abs=1e-14) for i in want)


def test_clipped_targets_are_positive():
    m = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    _, own, raised = spectra.pooled_targets(np.eye(3), m, 1, 100, np.full(3, 0.7))
    assert raised >= 1 and np.linalg.eigvalsh(own).min() > 0 and np.allclose(np.diag(own), 1)


def test_rank_matched_p(spark):
    seen = spark.createDataFrame([("total", 1, 4.0), ("total", 2, 1.0)], "part string, rank int, value double")
    nulls = spark.createDataFrame([(d, "total", k, float(v)) for k in (1, 2) for d, v in enumerate((1, 2, 3))], "draw int, part string, rank int, value double")
    assert {r["rank"]: r.p for r in spectra.spectrum_p(seen, nulls).collect()} == {1: 0.25, 2: 1.0}


def test_permutation_spectra_by_hash_make_no_table_of_units_and_draws(spark, views, monkeypatch):
    """The sums of halves in tasks give the spectra of relabelled units in blocks of features, from long residuals and from vectors."""
    _, residuals = views
    few = residuals.where("feature < 'f12'")
    values = lambda df: {(r.draw, r.part, r["rank"]): r.value for r in df.collect()}
    parents = tuple(spectra.unit_vectors(few, [v]) for v in ("MIX.SC", "MIX.SE"))
    want = values(spectra.spectra(spectra.null_blocks(spectra.relabelled_units(parents, spectra.unit_vectors(few, ["HYB.SC", "HYB.SE"]), 9, 5)), 6))
    vectors = few.groupBy("dataset", "unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "r"))), lambda x: x["r"]).alias("x"))
    monkeypatch.setattr(spectra, "relabelled_units", None)
    for df in (few, vectors):
        got = values(spectra.permutation_spectra(df, 9, 6, 5))
        assert set(got) == set(want) and len(got) == 10 * 3 * 6 and all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-12) for i in want)
