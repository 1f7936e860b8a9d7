"""Clusters, covariates, rankings by variance and row-wise errors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispersa.operators import bootstrap, clusters, rowwise, states
from dispersa.operators.resampling import hashed_pick


@pytest.fixture(scope="module")
def two(spark):
    """Counts of two views of 30 units, their clusters, and the dense matrices."""
    rng = np.random.default_rng(5)
    y = {d: rng.poisson(1.0, (6, 30)) for d in ("A", "B")}
    at = {"A": np.arange(30) % 3, "B": np.where(np.arange(30) < 24, np.arange(30) % 3, 0)}
    rows = [(d, f"f{i}", f"u{j}", int(m[i, j])) for d, m in y.items() for i in range(6) for j in range(30) if m[i, j]]
    label = [(d, f"u{j}", int(at[d][j])) for d in y for j in range(30)] + [("A", "lost", None)]
    return y, at, spark.createDataFrame(rows, "dataset string, feature string, unit string, y long"), spark.createDataFrame(label, "dataset string, unit string, cluster int")


def test_cluster_correlations(two):
    y, at, counts, label = two
    got = {(r.cluster_a, r.cluster_b): r.cor for r in clusters.cluster_correlations(counts, label, [("A", "B")], 9).collect()}
    big = {d: [k for k in range(3) if (at[d] == k).sum() >= 9] for d in y}
    assert set(got) == {(a, b) for a in big["A"] for b in big["B"]} and len(got) == 3  # the second view has one cluster of that size
    for (a, b), cor in got.items():
        assert cor == pytest.approx(np.corrcoef(y["A"][:, at["A"] == a].sum(1), y["B"][:, at["B"] == b].sum(1))[0, 1])
    best = clusters.comparison_cluster(counts, label, "A", "B", 9).collect()
    whole = [np.corrcoef(y["A"][:, at["A"] == a].sum(1), y["B"].sum(1))[0, 1] for a in range(3)]
    assert [(r.cluster_a, r.cluster_b) for r in best] == [(int(np.argmax(whole)), 0)]
    assert clusters.comparison_cluster(counts, label, "B", "A", 9).count() == 0


def test_profiles_that_share_nothing(spark):
    a = spark.createDataFrame([("x", "f1", 2), ("x", "f2", 1), ("flat", "f1", 1), ("flat", "f2", 1), ("flat", "f3", 1)], "id string, feature string, y long")
    b = spark.createDataFrame([("z", "f3", 5)], "id string, feature string, y long")
    features = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature string")
    got = {r.a: r.cor for r in clusters.profile_correlations(a, b, features).collect()}
    assert got["x"] == pytest.approx(np.corrcoef([2, 1, 0], [0, 0, 5])[0, 1]) and got["flat"] is None


def test_consistent_pairs_take_the_first_of_ties(spark):
    rows = [("A", f"u{i}", c) for i, c in enumerate([0, 0, 0, 1, 1, 2])] + [("B", f"u{i}", c) for i, c in enumerate([5, 5, 6, 5, 6, 6])] + [("A", "one", 0), ("B", "other", None)]
    label = spark.createDataFrame(rows, "dataset string, unit string, cluster int")
    got = clusters.consistent_pairs(clusters.cluster_crossing(label, "A", "B")).collect()
    assert [(r.a, r.b, r.n, round(r.share, 6)) for r in got] == [(0, 5, 2, round(2 / 6, 6))]  # 6 is tied between all three and goes to 0, which has gone to 5
    assert clusters.consistent_pairs(clusters.cluster_crossing(label.limit(0), "A", "B")).count() == 0


def test_covariate_diagnostic(spark):
    rng = np.random.default_rng(8)
    x, g = rng.normal(size=60), np.arange(60) % 4
    r = {"follows": x + 0.1 * rng.normal(size=60), "grouped": g + 0.2 * rng.normal(size=60), "none": rng.normal(size=60), "still": np.zeros(60)}
    rows = [(f"u{j}", f, float(v[j])) for f, v in r.items() for j in range(60)]
    scores = [(f"u{j}", float(x[j]), int(g[j])) for j in range(60)] + [("u60", None, 1), ("u61", 1.0, None)]
    got = clusters.covariate_diagnostic(spark.createDataFrame(rows, "unit string, feature string, r double"), spark.createDataFrame(scores, "unit string, x double, `group` int"))
    got = {row.feature: row for row in got.collect()}
    order = lambda v: np.argsort(np.argsort(v)) + 1.0
    for f in ("follows", "grouped", "none"):
        assert got[f].rho == pytest.approx(np.corrcoef(order(r[f]), order(x))[0, 1])
        between = sum((g == k).sum() * (r[f][g == k].mean() - r[f].mean()) ** 2 for k in range(4))
        assert got[f].eta2 == pytest.approx(between / ((r[f] - r[f].mean()) ** 2).sum())
        assert got[f].h == pytest.approx(12 / (60 * 61) * sum(order(r[f])[g == k].sum() ** 2 / (g == k).sum() for k in range(4)) - 3 * 61)
        assert got[f].rho_p <= got[f].rho_q and got[f].h_p <= got[f].h_q
    assert got["follows"].rho_q < 1e-6 < 0.05 < got["none"].rho_q and got["grouped"].h_q < 1e-6 < 0.05 < got["none"].h_q
    assert got["still"].rho is None and got["still"].eta2 is None and got["still"].h_p is None
    summary = {s.test: s for s in clusters.diagnostic_summary(spark.createDataFrame(list(got.values()))).collect()}
    assert (summary["covariate"].n, summary["covariate"].significant, summary["group"].significant) == (3, 1, 1)


def test_variance_ranking(spark):
    rng = np.random.default_rng(3)
    y = np.array([rng.negative_binomial(2, 2 / (2 + m), 80) for m in np.geomspace(0.3, 20, 12)])
    y[4, :40], y[4, 40:] = 0, 30
    rows = [("A", f"f{i:02}", f"u{j}", int(y[i, j])) for i in range(12) for j in range(80) if y[i, j]] + [("A", "gone", "u1", 0)]
    units = spark.createDataFrame([("A", f"u{j}") for j in range(80)], "dataset string, unit string")
    ranked = clusters.variance_ranking(spark.createDataFrame(rows, "dataset string, feature string, unit string, y long"), units)
    mean, var = y.mean(1), y.var(1, ddof=1)
    expected = 10 ** np.polyval(np.polyfit(np.log10(mean), np.log10(var), 2), np.log10(mean))
    z = np.minimum((y - mean[:, None]) / np.sqrt(expected)[:, None], np.sqrt(80))
    want = (z**2).sum(1) / 79
    got = ranked.orderBy("rank").collect()
    assert [r.feature for r in got] == [f"f{i:02}" for i in np.argsort(-want)] and got[0].feature == "f04"
    assert [r.standardised for r in got] == pytest.approx(sorted(want, reverse=True))
    v = np.sort(want)[::-1]
    v = v[v >= 1]
    hit = np.flatnonzero(v[:-1] - v[1:] > 0.2 * (v[0] - v[-1]))
    assert clusters.variance_elbow(ranked, 0.2).first().n_features == hit.max() + 2
    assert clusters.variance_elbow(ranked, 2.0).first().n_features == len(v)
    assert clusters.variance_elbow(ranked, 2.0, 1e9).first().n_features == 12


def test_component_elbow(spark):
    axes = spark.createDataFrame([(k, f, e) for k, e in ((1, 9.0), (2, 4.0), (3, 1.0), (4, 1.0)) for f in ("a", "b")], "rank int, feature string, eigenvalue double")
    assert clusters.component_elbow(axes).first().components == 3
    assert clusters.component_elbow(axes, 99.0).first().components is None


def test_correlation_draws_match_weighted_correlations(spark, monkeypatch):
    monkeypatch.setattr(rowwise, "UNITS", 7)  # several blocks of units
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3, 25)), rng.normal(size=(3, 25))
    b[1] += a[1]
    b[2] = 1.5  # no variance
    names = [f"u{j}" for j in range(25)]
    values = spark.createDataFrame([(f"f{i}", n, float(a[i, j]), float(b[i, j])) for i in range(3) for j, n in enumerate(names)], "feature string, unit string, a double, b double")
    units = bootstrap.coexpression_units(spark.createDataFrame([("HYB.SC", n, 1.0) for n in names], "dataset string, unit string, expo double")).where("grp = 2")
    got = {(r.feature, r.draw): r.r for r in rowwise.draw_correlations(values, units, 20, 4).collect()}
    place = {(r.stratum, r.pos): r.unit for r in units.collect()}
    w = np.zeros((21, 25))
    for r in bootstrap.unit_draws(units, 20, 4).collect():
        w[r.draw, names.index(place[r.stratum, r.pos])] += r.w
    assert len(got) == 63 and (w.sum(1) == 25).all()
    for i in range(2):
        for d in range(21):
            assert got[f"f{i}", d] == pytest.approx(np.corrcoef(np.repeat(a[i], w[d].astype(int)), np.repeat(b[i], w[d].astype(int)))[0, 1])
    assert all(got["f2", d] is None for d in range(21))
    attenuation = spark.createDataFrame([("f0", 0.5), ("f1", 0.8), ("f2", 0.9), ("elsewhere", 0.7)], "feature string, attn double")
    found = {r.feature: r for r in rowwise.correlation_errors(values, units, attenuation, 20, 2, 40, 4).collect()}
    assert set(found) == {"f0", "f1", "f2"} and found["f2"].se_obs is None
    assert found["f1"].se_obs == pytest.approx(np.std([got["f1", d] for d in range(1, 21)], ddof=1)) and found["f1"].se_true == pytest.approx(found["f1"].se_obs / 0.8)


def test_hashed_draws_of_correlations_are_found_in_tasks(spark, monkeypatch):
    """The same correlations as from a table of draws, which isn't made."""
    monkeypatch.setattr(rowwise, "UNITS", 7)
    names = [f"u{j}" for j in range(25)]
    values = spark.createDataFrame([("f", n, float(j * j % 11), float(j * 3 % 7)) for j, n in enumerate(names) if j != 4], "feature string, unit string, a double, b double")
    units = bootstrap.coexpression_units(spark.createDataFrame([("HYB.SC", n, 1.0) for n in names], "dataset string, unit string, expo double")).where("grp = 2")
    want = {r.draw: r.r for r in rowwise.draw_correlations(values, units, 20, 4, lambda *x: hashed_pick(*x)).collect()}
    for module in (bootstrap, rowwise):
        monkeypatch.setattr(module, "bootstrap_weights", None, raising=False)
    got = {r.draw: r.r for r in rowwise.draw_correlations(values, units, 20, 4).collect()}
    assert len(got) == 21 and got == pytest.approx(want)


def test_stratified_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("feature"), (F.col("id") / 7).alias("attn")).union(spark.createDataFrame([(5000, None), (5001, float("nan"))], "feature long, attn double"))
    binned = rowwise.quantile_bins(df, "attn", 10)
    assert {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()} == dict.fromkeys(range(1, 11), 100)
    taken = rowwise.stratified_sample(binned, "feature", "bin", 15, 3)
    assert {r["bin"]: r["count"] for r in taken.groupBy("bin").count().collect()} == dict.fromkeys(range(1, 11), 15)
    again = rowwise.stratified_sample(binned.repartition(7), "feature", "bin", 15, 3)
    assert sorted(r.feature for r in taken.collect()) == sorted(r.feature for r in again.collect())


def test_numbered_rows_and_equal_bins_with_a_hot_value(spark):
    rng = np.random.default_rng(6)
    v = np.where(np.arange(999) % 3 == 0, 5, rng.integers(0, 1000, 999)).tolist()  # a third of all rows hold one value
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, v long").repartition(5)
    got = {r.id: r.place for r in states.numbered(df, ["v", "id"], "place").collect()}
    order = sorted(range(999), key=lambda i: (v[i], i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    none = spark.createDataFrame([(2000, None)], "id long, v long")
    bins = {r.id: r.bin for r in states.equal_bins(df.union(none), "v", 7, "id").collect()}
    assert bins == {i: -(-(k + 1) * 7 // 999) for k, i in enumerate(order)}
    assert states.equal_bins(df.limit(0), "v", 7, "id").count() == 0
