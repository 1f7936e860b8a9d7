"""Simulated nulls of dispersion contrasts: draws by exposure, refits by the whole likelihood."""

from math import exp, floor, lgamma, log, log1p

import numpy as np

from dispersa.operators import inference
from dispersa.operators.fitting import LOG_PHI, _likelihood
from dispersa.plans import more_queries


def test_draws_of_many_units_follow_the_distribution():
    rng = np.random.Generator(np.random.Philox(1))
    for n, mean, phi in ((200_000, 2.5, 0.4), (7, 2.5, 0.4), (50_000, 0.2, 20.0), (3000, 900.0, 1e-4)):
        draw, y, cells = inference.drawn_counts(rng, n, mean, phi, 40)
        assert (np.bincount(draw, cells, 40) == n).all()
        got = np.array([np.average(y[draw == d], weights=cells[draw == d]) for d in range(40)])
        assert abs(got.mean() - mean) < 5 * np.sqrt((mean + phi * mean**2) / n / 40)
        low = np.bincount(draw, cells * (y <= mean), 40).mean() / n
        r = 1 / phi
        want = sum(exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) - r * log1p(phi * mean) + k * log(phi * mean / (1 + phi * mean))) for k in range(floor(mean) + 1))
        assert abs(low - want) < 5 * np.sqrt(want * (1 - want) / n / 40) + 1e-9


def test_simulated_dispersions_are_maxima_of_the_likelihood():
    """Each draw's dispersion is its own and lies around the one it was drawn with."""
    ef, en = np.array([0.5, 1.0, 2.0]), np.array([400.0, 500.0, 600.0])
    logs = inference.simulated_dispersions(np.random.Generator(np.random.Philox(2)), 3.0, 0.5, ef, en, 60)
    assert len(set(logs.round(6))) == 60 and abs(np.median(logs) + 1) < 0.1 and 0.02 < logs.std() < 0.3
    # the same draws again, one by one against a grid of the likelihood
    rng = np.random.Generator(np.random.Philox(2))
    drawn = [inference.drawn_counts(rng, int(n), 3.0 * e, 0.5, 60) for e, n in zip(ef, en)]
    grid = np.linspace(*LOG_PHI, 20_001)
    for d in (0, 31):
        y, cells, e = (np.concatenate(x) for x in zip(*[(x[1][x[0] == d], x[2][x[0] == d], np.full((x[0] == d).sum(), v)) for x, v in zip(drawn, ef)]))
        up = np.argsort(y, kind="stable")
        mu = (y * cells).sum() / (ef @ en)
        value = [_likelihood(np.exp(np.array([g])), (np.zeros(len(y), int), y[up].astype(float), cells[up], np.zeros(len(y), int), e, (y * cells).astype(float)), np.array([mu]), ef, en)[0] for g in grid[8000:16000]]
        assert abs(grid[8000 + int(np.argmax(value))] / np.log(2) - logs[d]) < 0.005


def test_p_tells_small_contrasts_from_large_ones(spark):
    units = spark.createDataFrame([(d, f"u{i:03d}", 1.0 + i % 3) for d in ("A", "B") for i in range(300)], "dataset string, unit string, expo double")
    rows = [(d, f, 3.0, p) for f, a, b in (("near", 0.5, 0.51), ("far", 0.2, 1.5)) for d, p in (("A", a), ("B", b))]
    fits = spark.createDataFrame(rows, "dataset string, feature string, mu double, disp double")
    got = {r.feature: r for r in inference.parametric_p(fits, units, {"A": 1.0, "B": -1.0}, 120, 3).collect()}
    assert got["near"].p > 0.5 and got["far"].p == 1 / 121 and got["near"].n == 120


def test_the_query_takes_the_references_draws():
    assert more_queries.SIMULATED == 2000
