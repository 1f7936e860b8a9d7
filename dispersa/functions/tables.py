"""Likelihood terms of count models as tables over a log grid: many draws and features share them, and a lookup replaces a sum over cells."""

from __future__ import annotations

import numpy as np

STEP = 0.2
#: Log grid of phi mu exposure, and log grid of phi; beyond an end a table goes on along its tangent.
RATES, SIZES = np.arange(-26.0, 14.0 + STEP / 2, STEP), np.arange(-15.2, 4.2 + STEP / 2, STEP)

#: Terms of log(1 + phi j) are added one by one below this count and by series of log-gamma above it.
EXACT = 1024


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _digamma(x: np.ndarray) -> np.ndarray:
    return np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def rising_terms(counts: np.ndarray, log_phi: np.ndarray = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Sums over j < y of log(1 + phi j), and their slopes in log phi: one row a phi, one column a count; any count costs the same."""
    phi = np.exp(log_phi)[:, None]
    j = np.arange(int(min(counts.max(initial=1), EXACT)))[None]
    at = np.minimum(counts, EXACT).astype(np.int64)
    zero = np.zeros((len(log_phi), 1))
    value = np.concatenate([zero, np.cumsum(np.log1p(phi * j), axis=1)], axis=1)[:, at]
    slope = np.concatenate([zero, np.cumsum(phi * j / (1 + phi * j), axis=1)], axis=1)[:, at]
    big = counts > EXACT
    if big.any():
        y, theta = counts[None, big].astype(float), 1 / phi
        value[:, big] += _log_gamma(y + theta) - _log_gamma(EXACT + theta) + (y - EXACT) * np.log(phi)
        slope[:, big] += (y - EXACT) - theta * (_digamma(y + theta) - _digamma(EXACT + theta))
    return value, slope


class LogTable:
    """A positive function of log x, as logs of its values and their slopes on a grid of x, one column a lane; 0 where it is 0 throughout."""

    def __init__(self, grid: np.ndarray, values: np.ndarray, slopes: np.ndarray):
        self.grid, self.there = grid, values[-1] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log = np.where(self.there, np.log(values), 0.0)
            self.tangent = np.where(self.there, slopes / values, 0.0)

    def __call__(self, x: np.ndarray, lane: np.ndarray | None = None) -> np.ndarray:
        """Values at x, one for each lane or for the lanes given; cubic between grid points."""
        lane = np.arange(len(x)) if lane is None else lane
        i = np.clip(((x - self.grid[0]) / STEP).astype(np.int64), 0, len(self.grid) - 2)
        u = (x - self.grid[i]) / STEP
        a, b, p, q = self.log[i, lane], self.log[i + 1, lane], self.tangent[i, lane] * STEP, self.tangent[i + 1, lane] * STEP
        inner = a + u * (p + u * (3 * (b - a) - 2 * p - q + u * (2 * (a - b) + p + q)))
        out = np.where(u < 0, a + u * p, np.where(u > 1, b + (u - 1) * q, inner))
        return np.where(self.there[lane], np.exp(out), 0.0)


def exposure_tables(expo: np.ndarray, weights: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over units of w log(1 + t e), w e / (1 + t e) and w e^2 / (1 + t e)^2: one row a t of the grid, one column a draw."""
    t = np.exp(RATES)[:, None]
    sums = [np.zeros((len(RATES), weights.shape[1])) for _ in range(3)]
    for low in range(0, len(expo), block):
        e, w = expo[None, low : low + block], weights[low : low + block]
        ratio = e / (1 + t * e)
        for total, part in zip(sums, (np.log1p(t * e), ratio, ratio * ratio)):
            total += part @ w
    return sums[0], sums[1], sums[2]


def golden(f, low: np.ndarray, high: np.ndarray, width: float = 1e-5) -> np.ndarray:
    """The maximum of f on all lanes at once by golden sections."""
    g = (np.sqrt(5) - 1) / 2
    a, b = low.copy(), high.copy()
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while (b - a).max(initial=0.0) > width:
        left = fc >= fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - g * (b - a), a + g * (b - a))
        fn = f(new)
        c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, fn, fd), np.where(left, fc, fn)
    return (a + b) / 2


def weighted_fits(y: np.ndarray, e: np.ndarray, weights: np.ndarray, whole: tuple[LogTable, LogTable], lanes: np.ndarray, sums: np.ndarray, log_phi: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(mu, phi) of one feature for each column of weights: ratio of sums, and the maximum of the adjusted likelihood.

    y, e: stored counts and their exposures, weights: one column a lane. whole: the tables of log(1 + t e) and of e / (1 + t e) over all
    units, whose column for each lane is in `lanes`; sums: per lane the weighted sums of e and e^2 over all units. phi is 0 where the
    likelihood falls from there, and nan, with mu 0, where a lane has no count.
    """
    sy, sy2, sye = y @ weights, (y * y) @ weights, (y * e) @ weights
    se, se2 = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = np.where(se > 0, sy / se, np.nan)
        slope0 = sy2 - 2 * mu * sye + mu * mu * se2 - mu * se + mu * se2 / se
    phi = np.where(sy > 0, 0.0, np.nan)
    open_ = np.flatnonzero((sy > 0) & (slope0 > 0))
    if not len(open_):
        return mu, phi
    w, t = weights[:, open_], np.exp(RATES)[:, None]
    product = LogTable(RATES, (np.log1p(t * e) * y) @ w, (t * e / (1 + t * e) * y) @ w)
    levels, at = np.unique(y, return_inverse=True)
    held = np.zeros((len(levels), len(open_)))
    np.add.at(held, at, w)
    phi[open_] = _maxima(levels, held, product, whole, mu[open_], lanes[open_], log_phi)
    return mu, phi


def _maxima(levels: np.ndarray, held: np.ndarray, product: LogTable, whole: tuple[LogTable, LogTable], mu: np.ndarray, lane: np.ndarray, log_phi: tuple[float, float]) -> np.ndarray:
    """The dispersion at the maximum of the adjusted likelihood of each lane; held: how often each count of `levels` is in it."""
    value, slope = rising_terms(levels)
    rising, log_mu = LogTable(SIZES, value @ held, slope @ held), np.log(mu)

    def likelihood(x: np.ndarray) -> np.ndarray:
        rate = x + log_mu
        return rising(x) - product(rate) - whole[0](rate, lane) * np.exp(-x) - 0.5 * (log_mu + np.log(whole[1](rate, lane)))

    return np.exp(golden(likelihood, np.full(len(mu), log_phi[0]), np.full(len(mu), log_phi[1])))


def table_fits(levels: np.ndarray, held: np.ndarray, e: np.ndarray, counted: np.ndarray, whole: tuple[LogTable, LogTable], sums: np.ndarray, log_phi: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """weighted_fits of a feature from how often each count of `levels` is in a lane (held) and what a lane counts at each exposure (counted)."""
    sy, sy2, sye = levels @ held, (levels * levels) @ held, e @ counted
    se, se2 = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = np.where(se > 0, sy / se, np.nan)
        slope0 = sy2 - 2 * mu * sye + mu * mu * se2 - mu * se + mu * se2 / se
    phi = np.where(sy > 0, 0.0, np.nan)
    open_, t = np.flatnonzero((sy > 0) & (slope0 > 0)), np.exp(RATES)[:, None]
    if len(open_):
        product = LogTable(RATES, np.log1p(t * e) @ counted[:, open_], (t * e / (1 + t * e)) @ counted[:, open_])
        phi[open_] = _maxima(levels, held[:, open_], product, whole, mu[open_], open_, log_phi)
    return mu, phi
