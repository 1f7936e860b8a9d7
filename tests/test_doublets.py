"""Doublet scores against brute-force neighbours, and on planted doublets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispersa.operators import doublets


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.Generator(np.random.Philox(2))
    means = rng.gamma(0.5, 4, (3, 40))
    one = [rng.poisson(means[i % 3]) for i in range(240)]
    two = [rng.poisson(means[i % 3] + means[(i + 1) % 3]) for i in range(15)]
    x = np.array(one + two)
    rows = [(f"u{i:03d}", f"g{j:02d}", int(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    return x, spark.createDataFrame(rows, "unit string, feature string, y long")


def test_planted_doublets_score_higher(planted):
    _, counts = planted
    got = {r.unit: r for r in doublets.doublet_scores(counts, n_hvg=30, n_pc=5).collect()}
    assert len(got) == 255 and all(0 < r.score < 1 for r in got.values())
    single, double = ([got[f"u{i:03d}"].score for i in ids] for ids in (range(240), range(240, 255)))
    assert np.median(double) > 3 * np.median(single) and np.mean(np.array(double) > np.quantile(single, 0.9)) > 0.8


def test_components_equal_a_dense_decomposition(planted):
    x, counts = planted
    depth = float(np.median(x.sum(1)))
    seen = doublets.log_scaled(counts, "unit", depth)
    z = np.log1p(x / x.sum(1, keepdims=True) * depth)
    features = doublets.most_variable(seen, len(x), 12)
    names = [r.feature for r in features.orderBy("at").collect()]
    assert set(names) == {f"g{j:02d}" for j in np.argsort(-z.var(0))[:12]}
    mean, rotation = doublets.components(seen, len(x), features, 4)
    own = z[:, [int(n[1:]) for n in names]]
    values, vectors = np.linalg.eigh(np.cov(own.T))
    assert np.allclose(mean, own.mean(0)) and np.allclose(np.abs((rotation * vectors[:, ::-1][:, :4]).sum(0)), 1)
    units = counts.select("unit").distinct()
    got = {r.unit: r.e for r in doublets.embedded(seen, units, "unit", features, (mean, rotation)).collect()}
    assert np.allclose(np.array([got[f"u{i:03d}"] for i in range(len(x))]), (own - mean) @ rotation)


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(doublets, "QUERIES", 100)
    monkeypatch.setattr(doublets, "POINTS", 130)
    rng = np.random.Generator(np.random.Philox(9))
    e = np.round(rng.normal(size=(500, 4)), 1)  # with ties
    points = spark.createDataFrame([(int(i >= 300), int(i % 300), [float(v) for v in r]) for i, r in enumerate(e)], "kind int, id long, e array<double>")
    got = {r.id: [(n.kind, n.id) for n in r.near] for r in doublets.nearest(points.where("kind = 0"), points, 7).collect()}
    for i in range(300):
        d = ((e[i] - e) ** 2).sum(1)
        d[i] = np.inf
        want = sorted(d)[:7]
        have = [d[n if kind == 0 else 300 + n] for kind, n in got[i]]
        assert len(got) == 300 and np.allclose(have, want, atol=1e-9) and len(set(got[i])) == 7


def test_neighbours_are_not_shuffled(spark, monkeypatch):
    """Blocks meet where they are read; a query's result is one number, and ties go by kind, then id."""
    monkeypatch.setattr(doublets, "QUERIES", 70)
    monkeypatch.setattr(doublets, "POINTS", 90)
    rng = np.random.Generator(np.random.Philox(4))
    e = rng.integers(0, 3, (400, 3)).astype(float)  # mostly ties
    points = spark.createDataFrame([(int(i >= 150), int(i % 150 if i < 150 else i - 150), [float(v) for v in r]) for i, r in enumerate(e)], "kind int, id long, e array<double>")
    found = doublets.near_kind(points.where("kind = 0"), points, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan
    got = {r.id: r.n for r in found.collect()}
    for i in range(150):
        d = ((e[i] - e) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == (np.argsort(d, kind="stable")[:20] >= 150).sum()


def test_simulated_units_are_sums_of_two(spark, planted):
    x, counts = planted
    units = doublets.numbered(counts.select("unit").distinct())
    assert sorted(r.pos for r in units.collect()) == list(range(255))
    sums = doublets.simulated(counts, units, 50, 3, pick=lambda i, side: i * 7 + side * (i % 5)).groupBy("id").agg(F.sum("y").alias("s")).collect()
    at = {r.pos: int(r.unit[1:]) for r in units.collect()}
    for r in sums:
        a, b = r.id * 7 % 255, (r.id * 7 + r.id % 5) % 255
        b = (b + 1) % 255 if a == b else b
        assert r.s == x[at[a]].sum() + x[at[b]].sum()


def test_few_units(spark):
    none = spark.createDataFrame([], "unit string, feature string, y long")
    assert doublets.doublet_scores(none).collect() == []
    assert [tuple(r) for r in doublets.doublet_scores(spark.createDataFrame([("a", "g", 3)], "unit string, feature string, y long")).collect()] == [("a", None, None)]


def test_units_with_the_same_counts_are_searched_once(spark, monkeypatch):
    rng = np.random.Generator(np.random.Philox(6))
    own = rng.poisson(2.0, (30, 8))
    own[:, 0] += 1
    rows = [(f"u{c}{i:02d}", f"g{j}", int(v)) for c in range(4) for i, r in enumerate(own) for j, v in enumerate(r) if v]
    counts = spark.createDataFrame(rows, "unit string, feature string, y long")
    kinds, searched = {tuple(r) for r in own.tolist()}, []
    search = doublets.near_kind
    monkeypatch.setattr(doublets, "near_kind", lambda q, p, k: searched.append((q.count(), p.count())) or search(q, p, k))
    got = {r.unit: r.frac for r in doublets.doublet_scores(counts, n_hvg=8, n_pc=3).collect()}
    assert searched == [(len(kinds), 360)] and len(got) == 120
    assert all(len({got[f"u{c}{i:02d}"] for c in range(4)}) == 1 for i in range(30))


def test_kinds_of_many_neighbours_equal_an_order(monkeypatch):
    """Blocks, cuts and single precision lose no neighbour: close distances, ties and points of one place."""
    monkeypatch.setattr(doublets, "ROWS", 16)
    monkeypatch.setattr(doublets, "COLUMNS", 32)
    rng = np.random.Generator(np.random.Philox(7))
    y = np.concatenate([rng.normal(size=(300, 5)), rng.normal(size=(300, 5)) * 1e-4 + 3, np.repeat(rng.normal(size=(4, 5)), 50, axis=0)])
    kind, ids = rng.integers(0, 2, len(y)).astype(np.int32), np.arange(len(y))
    for k in (3, 40, 900):
        state = doublets._Kinds(kind, ids, y, k)
        for a in range(0, len(y), 100):
            state.meet(kind[a : a + 100], ids[a : a + 100], y[a : a + 100])
        for i, n in enumerate(state.found()):
            d = np.round(((y - y[i]) ** 2).sum(1), doublets.DIGITS)
            others = np.delete(np.arange(len(y)), i)
            assert n == kind[others[np.lexsort((kind[others], d[others]))[:k]]].sum()
