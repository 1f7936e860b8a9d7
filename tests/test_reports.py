"""Tails against numeric integration; reports on small planted tables."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dispersa.functions import tails
from dispersa.operators import axes, contrasts, fitting, reports, spectra
from dispersa.sources import results


def integral(density, low, high, n=400_001):
    x = np.linspace(low, high, n)
    y = density(x)
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


def test_tails_against_integration(spark):
    t = lambda k: lambda x: math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + x * x / k) ** (-(k + 1) / 2)
    chi = lambda k: lambda x: x ** (k / 2 - 1) * np.exp(-x / 2) / 2 ** (k / 2) / math.gamma(k / 2)
    f = lambda a, b: lambda x: math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2) * x ** (a / 2 - 1) * (1 + a * x / b) ** (-(a + b) / 2)
    rows, want = [], []
    for k, x in ((3, 0.4), (5, 2.0), (12, 3.5), (200, 1.0)):
        rows.append((0, x, float(k), 1.0))
        want.append(1 - integral(t(k), -x, x))
        rows.append((1, x * 3, float(k), 1.0))
        want.append(1 - integral(chi(k), 1e-12, x * 3))
        rows.append((2, x, float(k), 7.0))
        want.append(1 - integral(f(k, 7), 1e-12, x))
    rows += [(3, 1.959964, 0.0, 0.0), (4, 1.0, 10.0, 0.0), (0, None, 3.0, 0.0), (1, 0.0, 2.0, 0.0), (0, 1.0, 0.0, 0.0)]
    want += [0.05, 0.0, None, 1.0, None]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind int, x double, a double, b double")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    p = F.when(F.col("kind") == 0, tails.student_p(x, a)).when(F.col("kind") == 1, tails.chi2_p(x, a)).when(F.col("kind") == 2, tails.f_p(x, a, b)).when(F.col("kind") == 3, tails.normal_p(x)).otherwise(tails.correlation_p(x, a))
    got = [r.p for r in df.select("i", p.alias("p")).orderBy("i").collect()]
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, abs=2e-5))


def test_maximiser_finds_the_top_of_each():
    top = np.array([-3.0, 0.2, 4.0, 9.9])
    got = fitting._maximise(lambda x: -np.abs(x - top) ** 1.5, np.full(4, -10.0), np.full(4, 10.0))
    assert np.allclose(got, top, atol=1e-6)


def test_burst_sizes_take_the_mean_of_the_mean_split(spark):
    fits = spark.createDataFrame([("A", "g", 2.0, 0.5), ("A.N", "g", 4.0, 0.25), ("B", "g", 3.0, 0.0), ("A", "h", 1.0, 1.0)], "dataset string, feature string, mu double, disp double")
    groups = contrasts.mode_groups(spark, {"m": {"A.N": 1.0, "B": -1.0}})
    got = {r.feature: r for r in reports.burst_contrasts(fits, groups).collect()}
    assert got["g"].bsize == pytest.approx(2.0 * 0.25 - 0.0) and got["g"].kbal is None and "h" not in got


def test_ratio_axes_of_zero_dispersions(spark):
    rows = [("A", "g", 2.0, 0.0), ("B", "g", 1.0, 0.5), ("A", "h", 2.0, 0.0), ("B", "h", 1.0, 0.0), ("A", "i", 0.0, 0.3), ("B", "i", 1.0, 0.3)]
    fits = spark.createDataFrame(rows, "dataset string, feature string, mu double, disp double")
    got = {r.feature: r for r in reports.ratio_axes(fits, "A", "B", zero_inf=True).collect()}
    assert got["g"].disp == -math.inf and got["h"].disp is None and got["i"].mu is None and got["i"].cv2 is None and got["i"].rdisp == 0
    assert {r.feature: r.disp for r in reports.ratio_axes(fits, "A", "B").collect()}["g"] is None


def test_weighted_median_and_empty_windows(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 5), ("b", 3.0, 0), ("b", None, 4)], "g string, v double, w int")
    assert [tuple(r) for r in reports.weighted_median(df, "v", "w", ["g"]).collect()] == [("a", 9.0)]
    windows = spark.createDataFrame([("s", 5, 25), ("t", 0, 3)], "seqid string, start int, `end` int")
    track = spark.createDataFrame([("s", 4, 1.0), ("s", 5, 2.0), ("s", 25, 4.0), ("s", 26, 9.0), ("s", 12, None)], "seqid string, pos int, v double")
    got = {r.seqid: (r.n, r.occupancy) for r in reports.mean_occupancy(windows, track, "v", ["seqid"], 10).collect()}
    assert got == {"s": (2, 3.0), "t": (0, None)}


def test_clear_clusters_are_stable_and_poles_apart(spark):
    rng = np.random.Generator(np.random.Philox(2))
    rows = [(i, float(c * 50 + rng.normal()), float(rng.normal())) for i, c in enumerate([0, 1] * 60)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    vec = df.select("id", array_to_vector(F.array("x", "y")).alias("vec"))
    runs = reports.cluster_stability(vec, "vec", "id", 2, 3).collect()
    assert all(r.ari == 1 and 50 < r.n < 100 for r in runs)
    poles = reports.two_normals(df, "x", "id").collect()
    assert all(r.pole == r.id % 2 for r in poles)


def test_a_planted_axis_is_a_candidate(spark):
    n = 40
    v = np.r_[np.full(20, 1.0), np.full(20, -1.0)] / math.sqrt(n)
    m = 8 * np.outer(v, v)
    pairs = spark.createDataFrame([(f"f{i:02d}", f"f{j:02d}", float(m[i, j])) for i in range(n) for j in range(i)], "i string, j string, r double")
    got = axes.candidate_axes(spectra.leading_axes(pairs, "r", 5), 0.5, 10.0).collect()
    assert len(got) == 1 and got[0]["rank"] == 1 and got[0].participation == pytest.approx(n, rel=1e-6)


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "k int, g string, v double")
    for kind in ("parquet", "csv"):
        results.write_result(df, str(tmp_path / kind), kind)
        back = spark.read.schema(df.schema).option("header", True).format(kind).load(str(tmp_path / kind))
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "t.tsv").write_text("ORF\tMean\tCV %\nA\t10\t20\nB\tNA\t3\nC\t5\t-\n")
    got = results.read_summary(spark, str(tmp_path / "t.tsv"), {"feature": "ORF", "mean": "Mean", "noise": "CV %"}, "percent").collect()
    assert [(r.feature, r.mean, round(r.cv2, 9)) for r in got] == [("A", 10.0, 0.04)]
