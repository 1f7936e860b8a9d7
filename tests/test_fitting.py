"""Dispersion fits against dense likelihoods with gamma functions."""

import math

import numpy as np

from dispersa.operators import fitting


def tables(spark, mu, phi, n=400, seed=3):
    rng = np.random.Generator(np.random.Philox(seed))
    e = np.round(rng.lognormal(0, 0.4, n), 2) + 0.05
    units = spark.createDataFrame([("d", f"u{i}", float(x)) for i, x in enumerate(e)], "dataset string, unit string, expo double")
    rows, dense = [], {}
    for f, (m, p) in enumerate(zip(mu, phi, strict=True)):
        lam = m * e * (rng.gamma(1 / p, p, n) if p > 0 else 1.0)
        y = rng.poisson(lam)
        dense[f"f{f}"] = y
        rows += [("d", f"f{f}", f"u{i}", int(k)) for i, k in enumerate(y) if k]
    return spark.createDataFrame(rows, "dataset string, feature string, unit string, y long"), units, e, dense


def dense_loglik(y, m, phi):
    k = 1 / phi
    lg = np.vectorize(math.lgamma)
    return float((lg(y + k) - lg(k) - lg(y + 1) + k * np.log(k / (k + m)) + y * np.log(m / (k + m))).sum() - 0.5 * math.log((m / (1 + phi * m)).sum()))


def test_fit_is_the_maximum_of_the_dense_likelihood(spark):
    counts, units, e, dense = tables(spark, [2, 5, 0.5, 3], [0.3, 0.8, 0.2, 0.05])
    for r in fitting.fit_dispersions(counts, units).collect():
        y = dense[r.feature]
        m = y.sum() / e.sum() * e
        assert abs(r.mu - y.sum() / e.sum()) < 1e-9
        if r.disp_app > 0:
            here = dense_loglik(y, m, r.disp_app)
            assert all(dense_loglik(y, m, r.disp_app * s) <= here + 1e-9 for s in (0.98, 1.02, 0.5, 2))
        assert r.disp_upper >= r.disp


def test_boundary_and_classes(spark):
    counts, units, _, _ = tables(spark, [5, 0.02], [1.0, 0.0])
    got = {r.feature: r for r in fitting.fit_dispersions(counts, units).collect()}
    assert got["f0"]["class"] == 1 and got["f0"].boundary == 0
    assert got["f1"]["class"] in (2, 3)


def test_sparse_sums_equal_dense_ones(spark):
    counts, units, e, dense = tables(spark, [1.5], [0.4])
    r = fitting.sufficient(counts, units).first()
    y = dense["f0"]
    m = y.sum() / e.sum() * e
    assert abs(r.slope0 - (((y - m) ** 2).sum() - m.sum() + (m**2).sum() / m.sum())) < 1e-6


def test_large_counts_are_summed_by_the_integral():
    y = np.array([0, 1, 2, 511, 512, 513, 514, 900, 20_000, 300_000], float)
    for phi in (1e-300, 3e-7, 1e-3, 0.4, 50.0):
        want = [np.log1p(phi * np.arange(1, k)).sum() for k in y]
        assert np.allclose(fitting._log_rises(np.full(len(y), phi), y), want, rtol=1e-11, atol=1e-9)


def test_fit_with_large_counts(spark):
    counts, units, e, dense = tables(spark, [3000, 40], [0.3, 0.6])
    for r in fitting.fit_dispersions(counts, units).collect():
        y = dense[r.feature]
        m = y.sum() / e.sum() * e
        here = dense_loglik(y, m, r.disp_app)
        assert y.max() > 512 or r.feature == "f1"
        assert all(dense_loglik(y, m, r.disp_app * s) < here for s in (0.99, 1.01, 0.5, 2))
