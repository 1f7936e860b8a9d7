"""Profile likelihood of paired dispersions and Tukey's pairs against plain numpy."""

import math

import numpy as np
import pytest

from dispersa.functions import tails
from dispersa.operators import profiles, reports


def direct(y1, y2, e):
    lg = np.vectorize(math.lgamma)
    lt = np.arange(-4, 15.05, 0.1)

    def grid(y):
        m = y.sum() / e.sum() * e
        return np.array([(lg(y + t) - lg(t) + t * np.log(t) - (t + y) * np.log(t + m)).sum() for t in np.exp(lt)])

    a, b, n = grid(y1), grid(y2), len(lt)
    shifts = np.arange(-(n - 1), n)
    prof = np.array([max(a[i] + b[i + d] for i in range(max(0, -d), min(n, n - d))) for d in shifts])
    dev, j = 2 * (prof.max() - prof), int(prof.argmax())
    pos = float(shifts[j])
    if 0 < j < len(prof) - 1 and (den := prof[j - 1] - 2 * prof[j] + prof[j + 1]) < 0:
        pos += 0.5 * (prof[j - 1] - prof[j + 1]) / den
    left, right, crit = j, j, 3.841458820694124
    while left > 0 and dev[left - 1] <= crit:
        left -= 1
    while right < len(dev) - 1 and dev[right + 1] <= crit:
        right += 1
    lo = -math.inf if left == 0 else shifts[left] - (crit - dev[left]) / (dev[left - 1] - dev[left])
    hi = math.inf if right == len(dev) - 1 else shifts[right] + (crit - dev[right]) / (dev[right + 1] - dev[right])
    out = [v * 0.1 / math.log(2) for v in (pos, lo, hi)]
    return [out[0], *[math.copysign(math.inf, v) if abs(v) > 10 else v for v in out[1:]]]


def test_profile_equals_a_direct_one_on_20_features(spark):
    rng = np.random.Generator(np.random.Philox(6))
    e = np.round(rng.lognormal(0, 0.4, 150), 2) + 0.05
    rows, dense = [], {}
    for f in range(20):
        for d, phi in (("HYB.SC", (0.01, 0.3, 1.0)[f % 3]), ("HYB.SE", (0.2, 0.0, 1.0, 0.5)[f % 4])):
            lam = rng.choice([0.3, 2, 6]) * e * (rng.gamma(1 / phi, phi, 150) if phi else 1.0)
            y = rng.poisson(lam) * (0 if f == 19 and d == "HYB.SE" else 1)
            dense[f, d] = y.astype(float)
            rows += [(d, f"g{f:02d}", f"u{i}", int(v)) for i, v in enumerate(y) if v]
    counts = spark.createDataFrame(rows, "dataset string, feature string, unit string, y long")
    units = spark.createDataFrame([(f"u{i}", float(x)) for i, x in enumerate(e)], "unit string, expo double")
    got = {r.feature: r for r in profiles.paired_profile(profiles.likelihood_grid(counts, units)).collect()}
    assert set(got) == {f"g{f:02d}" for f in range(19)}
    for f in range(19):
        r = got[f"g{f:02d}"]
        want = direct(dense[f, "HYB.SC"], dense[f, "HYB.SE"], e)
        assert [r.lo, r.hi] == pytest.approx(want[1:], rel=1e-4, abs=1e-4)
        # where neither side is bounded the profile is flat around its peak, and the direct sums of log-gammas place it no better than this
        assert r.est == pytest.approx(want[0], rel=1e-4, abs=1e-4 if math.isfinite(r.lo) or math.isfinite(r.hi) else 0.1)


def test_a_profile_makes_its_grid_once(spark):
    """Cells of equal count and exposure reach a task as one row, and both alleles read one grid."""
    counts = spark.createDataFrame([(d, "g", f"u{i}", 1 + i % 2) for d in ("HYB.SC", "HYB.SE") for i in range(100)], "dataset string, feature string, unit string, y long")
    units = spark.createDataFrame([(f"u{i}", 1.0) for i in range(100)], "unit string, expo double")
    plan = profiles.paired_profile(profiles.likelihood_grid(counts, units))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "Aggregate [feature#" in plan.split("MapInPandas stored")[1].split("MapInPandas")[0]


def test_studentised_range_table():
    # upper 5 % points of the studentised range
    for q, k, df in ((3.673, 3, 15), (3.877, 3, 10), (4.232, 5, 20), (2.950, 2, 20), (4.046, 4, 16), (3.633, 4, 1e9)):
        assert tails.studentised_range(np.array([q]), np.array([k]), np.array([df]))[0] == pytest.approx(0.05, abs=2e-4)


def test_tukey_pairs(spark):
    rng = np.random.Generator(np.random.Philox(3))
    groups = {"a": rng.normal(0, 1, 12), "b": rng.normal(0.2, 1, 20), "c": rng.normal(2, 1, 9)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(None, 1.0), ("a", None)], "g string, x double")
    got = {(r.first, r.second): r for r in reports.tukey_pairs(df, "x", "g").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    mse = sum(((x - x.mean()) ** 2).sum() for x in groups.values()) / (41 - 3)
    for (a, b), r in got.items():
        d = groups[b].mean() - groups[a].mean()
        q = abs(d) / math.sqrt(mse / 2 * (1 / len(groups[a]) + 1 / len(groups[b])))
        assert r["diff"] == pytest.approx(d) and r.q == pytest.approx(q) and r.p == pytest.approx(tails.studentised_range(np.array([q]), np.array([3]), np.array([38]))[0])
    flat = spark.createDataFrame([(g, float(v % 7)) for v in range(60) for g in "ab"], "g string, x double")
    assert reports.tukey_pairs(flat, "x", "g").collect() == []
