"""Edge cases of operators whose queries have no SQL or no such rows."""

import math

import numpy as np

from dispersa.functions import stats
from dispersa.operators import classes, coexpression, contrasts, enrichment, qc, resampling, states
from pyspark.sql import functions as F


def test_contrast_zero_is_negative_infinity(spark):
    fits = spark.createDataFrame([("MIX.SC", "f", 2.0, 0.0), ("MIX.SE", "f", 4.0, 0.5), ("MIX.SC", "g", 1.0, 0.2)], "dataset string, feature string, mu double, disp double")
    groups = contrasts.mode_groups(spark, {"total": contrasts.MODE_GROUPS["total"]})
    plain = {r.feature: r for r in contrasts.contrasts(fits, groups).collect()}
    assert plain["f"].disp is None and plain["f"].mean == -1.0 and plain["f"].raw == -0.5
    assert plain["g"].mean is None and plain["g"].raw is None
    assert {r.feature: r.disp for r in contrasts.contrasts(fits, groups, zero_inf=True).collect()}["f"] == -math.inf


def test_classes_with_nulls(spark):
    df = spark.createDataFrame([(0.01, None, 1.0, 1.0), (0.01, 0.01, None, 1.0), (0.01, 0.01, 1.0, -1.0)], "p double, q double, a double, b double")
    got = [r[0] for r in df.select(classes.regulatory_class(*[F.col(c) for c in "pqab"])).collect()]
    assert got == [None, "Ambiguous", "Compensatory"]


def test_bh_ties_nulls_and_order(spark):
    p = [0.01, 0.04, 0.04, None, 0.5, 0.001]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double").withColumn("f", F.lit(1))
    got = [r.q for r in stats.benjamini_hochberg(df, "p", ["f"]).orderBy("k").collect()]
    v = np.array([x for x in p if x is not None])
    rank = np.array([(v <= x).sum() for x in v])
    want = [min(1, min(v[j] * len(v) / rank[j] for j in range(len(v)) if v[j] >= x)) for x in v]
    assert got[3] is None and np.allclose([x for x in got if x is not None], want)


def test_density_valley(spark):
    rng = np.random.Generator(np.random.Philox(1))
    x = np.concatenate([rng.normal(-3, 0.3, 300), rng.normal(0, 0.3, 300)])
    got = qc.density_valley(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", adjust=0.8).first().valley
    assert -2.5 < got < -0.5
    assert qc.density_valley(spark.createDataFrame([(1.0,)] * 10, "x double"), "x").first().valley is None


def test_shrunken_correlations(spark):
    rng = np.random.Generator(np.random.Philox(2))
    x = rng.normal(size=(60, 4))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([("d", i, f"f{j}", float(x[i, j])) for i in range(60) for j in range(4)], "dataset string, unit int, feature string, r double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    n = len(z)
    w = z.T @ z / n
    r = w * n / (n - 1)
    var = n / (n - 1) ** 3 * (((z**2).T @ (z**2)) - n * w**2)
    up = np.triu_indices(4, 1)
    lam = min(1, max(0, var[up].sum() / (r[up] ** 2).sum()))
    got = {(a.i, a.j): a.r for a in coexpression.shrunken_correlations(df).collect()}
    assert all(abs(got[f"f{i}", f"f{j}"] - r[i, j] * (1 - lam)) < 1e-9 for i, j in zip(*up, strict=True))


def test_running_sum_score(spark):
    ranks = spark.createDataFrame([("l", f"f{i}", 10.0 - i) for i in range(10)], "list string, feature string, score double")
    terms = spark.createDataFrame([("top", "f0"), ("top", "f1"), ("end", "f9"), ("end", "f8")], "term string, feature string")
    got = {r.term: r.es for r in enrichment.running_sum_score(ranks, terms).collect()}
    assert abs(got["top"] - 1.0) < 1e-9 and abs(got["end"] + 1.0) < 1e-9


def test_term_closure(spark):
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "term string, feature string")
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "term string, parent string")
    assert {tuple(r) for r in enrichment.term_closure(t, p).collect()} == {("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")}


def test_relabeling_is_stable_under_partitioning(spark):
    units = spark.range(50).selectExpr("CAST(id AS STRING) AS unit")
    a = {tuple(r) for r in resampling.relabel_halves(units, 3, 5, 20).collect()}
    assert a == {tuple(r) for r in resampling.relabel_halves(units.repartition(7), 3, 5, 20).collect()}
    assert sum(h == 1 for *_, h in a) == 60


def test_module_scores(spark):
    values = spark.createDataFrame([(u, f"f{i}", float(i + (u if i < 3 else 0))) for u in range(4) for i in range(20)], "unit int, feature string, x double")
    members = spark.createDataFrame([("f0",), ("f1",), ("f2",)], "feature string")
    got = {r.unit: r.score for r in states.module_scores(values, members, bins=2, controls=5).collect()}
    assert got[3] > got[0]
