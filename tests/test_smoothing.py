"""Local trends against a fit of each window, row by row."""

import numpy as np
import pytest

from dispersa.operators import smoothing


def plain(x, y, at, k):
    """The trend at one place by least squares over the k nearest rows."""
    order = np.argsort(np.abs(x - at), kind="stable")[:k]
    xs, ys = x[order] - at, y[order]
    h = max(np.abs(xs).max(), 1e-12)
    w = np.sqrt((1 - np.minimum(np.abs(xs) / h, 1) ** 3) ** 3 + 1e-9)
    return np.linalg.lstsq(np.vander(xs / h, 3, increasing=True) * w[:, None], ys * w, rcond=None)[0][0]


@pytest.mark.parametrize(("rows", "places", "span"), [(40, None, 0.3), (700, None, 0.3), (3000, None, 0.3), (3000, 2, 0.3), (900, 1, 0.05), (500, None, 1.0)])
def test_trend_equals_a_fit_of_each_window(rows, places, span):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=rows) * 2
    x = x if places is None else np.round(x, places)
    y = np.sin(x) + rng.normal(size=rows) * 0.1
    k = max(4, int(np.ceil(span * rows)))
    levels, of = np.unique(x, return_inverse=True)
    got = smoothing.local_trend(levels, np.bincount(of), np.bincount(of, y), k)
    some = np.unique(np.linspace(0, len(levels) - 1, 60).astype(int))
    want = [plain(x, y, levels[i], k) for i in some]
    edge = 1e-6 if places is None else 2e-2  # few rows a level: which tied rows a window's edge takes is open
    assert np.allclose(got[some], want, atol=1e-6) or (places == 1 and np.median(np.abs(got[some] - want)) < edge)


def test_long_tables_take_no_window_for_each_row():
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(size=60_000))
    y = x * x + rng.normal(size=len(x)) * 0.1
    k = 18_000
    got = smoothing.local_trend(x, np.ones(len(x)), y, k)
    for i in (0, 17, 30_000, 59_999):
        assert got[i] == pytest.approx(plain(x, y, x[i], k), abs=1e-7)


def test_rows_without_a_log_have_no_value(spark):
    rows = [("a", i, float(1 + i % 9), 0.5) for i in range(20)] + [("a", 90, 0.0, 1.0), ("a", 91, 2.0, None), ("a", 92, 3.0, 0.0), ("b", 1, 2.0, 0.1), (None, 5, 1.0, 1.0)]
    got = {(r.source, r.feature): r.adjusted for r in smoothing.mean_adjusted_noise(spark.createDataFrame(rows, "source string, feature int, mean double, cv2 double")).collect()}
    assert len(got) == len(rows) and all(got["a", i] == pytest.approx(0, abs=1e-9) for i in range(20))
    assert [got[x] for x in (("a", 90), ("a", 91), ("a", 92), ("b", 1), (None, 5))] == [None] * 5
