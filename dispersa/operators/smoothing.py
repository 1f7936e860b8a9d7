"""Local trends and extrinsic fractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.sources.results import checkpointed


#: Levels of a leaf of the tree of moments, and levels that are fitted together.
LEAF, TOGETHER = 32, 2048
#: Powers of the distance that a tricube-weighted quadratic needs, for numbers of rows and for their values.
POWERS = (14, 12)
#: Condition of the normal equations beyond which a level's window is fitted directly.
WORST = 1e8


def _shifted(moments: np.ndarray, move: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums of (move + scale d)^j from those of d^j, a row a power; stable where |move| + |scale| is at most 1 and |d| too."""
    out = moments * scale ** np.arange(len(moments))[:, None]
    for j in range(1, len(out)):
        out[j:] += move * out[j - 1 : -1]
    return out


def _tree(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[tuple]:
    """(low, high, moments of n, moments of s) of each depth's nodes, from leaves up; moments about a node's middle, in its half widths."""
    m = len(x) // LEAF
    if not m:
        return []
    at = x[: m * LEAF].reshape(m, LEAF)
    low, high = at[:, 0], at[:, -1]
    d = (at - (low + high)[:, None] / 2) / ((high - low)[:, None] / 2)
    power = np.stack([d**j for j in range(POWERS[0])])
    depths = [(low, high, *((power[:p] * v[: m * LEAF].reshape(m, LEAF)).sum(2) for p, v in zip(POWERS, (n, s))))]
    while len(depths[-1][0]) > 1:
        low, high, *moments = depths[-1]
        pairs, own = len(low) // 2, slice(0, len(low) // 2 * 2)
        up_low, up_high = low[own][::2], high[own][1::2]
        middle, half = (up_low + up_high) / 2, (up_high - up_low) / 2
        sums = [np.zeros((p, pairs)) for p in POWERS]
        for side in (0, 1):
            a, b = low[own][side::2], high[own][side::2]
            for total, mine in zip(sums, moments):
                total += _shifted(mine[:, own][:, side::2], ((a + b) / 2 - middle) / half, (b - a) / 2 / half)
        depths.append((up_low, up_high, *sums))
    return depths


def _tricube(u: np.ndarray) -> np.ndarray:
    return (1 - np.minimum(u, 1) ** 3) ** 3 + 1e-9


def local_trend(x: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Local quadratic trend at each of the ascending distinct levels x, of which n rows have values that sum to s: tricube weights over the k nearest rows.

    Tricube weights are polynomials of the distance on either side, so the sums of a window follow from moments of log(levels) nodes of a tree
    and of few single levels: work and memory grow as levels times their logarithm. Rows tied at a window's edge stand for their mean.
    """
    x, n, s = (np.asarray(v, float) for v in (x, n, s))
    until = np.cumsum(n)
    rows = int(until[-1]) if len(x) else 0
    k = min(k, rows)
    level = lambda rank: np.searchsorted(until, rank, "right")
    a, b = np.zeros(len(x), np.int64), np.full(len(x), rows - k, np.int64)  # the least rank from which on the window may begin
    while (a < b).any():
        mid = (a + b) // 2
        ok = x[level(np.minimum(mid + k, rows - 1))] - x >= x - x[level(mid)]
        a, b = np.where(ok | (a >= b), a, mid + 1), np.where(ok, mid, b)
    first, last = level(a), level(a + k - 1)
    h = np.maximum(np.maximum(x - x[first], x[last] - x), 1e-12)
    tree, out = _tree(x, n, s), np.empty(len(x))
    for low in range(0, len(x), TOGETHER):
        own = np.arange(low, min(low + TOGETHER, len(x)))
        out[own] = _trend_of(own, x, n, s, until, tree, a[own], k, first[own], last[own], h[own])
    return out


def _trend_of(own, x, n, s, until, tree, start, k, first, last, h) -> np.ndarray:
    x0 = x[own]
    sums, values = np.zeros((5, len(own))), np.zeros((3, len(own)))

    def add(of: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        u = (x[at] - x0[of]) / h[of]
        w = _tricube(np.abs(u)) * count
        mean = s[at] / n[at]
        for p in range(5):
            sums[p, of] += w
            if p < 3:
                values[p, of] += w * mean
            w = w * u

    held = np.minimum(until[own], start + k) - np.maximum(until[own] - n[own], start)
    every = np.arange(len(own))
    add(every, own, held)
    left, right = every[first < own], every[last > own]
    add(left, first[left], until[first[left]] - start[left])
    add(right, last[right], start[right] + k - until[last[right]] + n[last[right]])
    for sign, begin, end in ((-1, first + 1, own), (1, own + 1, last)):
        head, tail = -(-begin // LEAF), end // LEAF
        whole = head < tail
        for lo, hi in ((begin, np.where(whole, head * LEAF, end)), (np.where(whole, tail * LEAF, end), end)):
            for step in range(int((hi - lo).max(initial=0))):
                of = np.flatnonzero(lo + step < hi)
                add(of, lo[of] + step, n[lo[of] + step])
        parts = [np.zeros((p, len(own))) for p in POWERS]
        for low, high, *moments in tree:
            for odd_end in (False, True):
                of = np.flatnonzero((head < tail) & ((tail if odd_end else head) % 2 == 1))
                node = tail[of] - 1 if odd_end else head[of]
                move, half = sign * ((low[node] + high[node]) / 2 - x0[of]) / h[of], sign * (high[node] - low[node]) / 2 / h[of]
                for total, mine in zip(parts, moments):
                    total[:, of] += _shifted(mine[:, node], move, half)
                head, tail = (head, np.where((head < tail) & (tail % 2 == 1), tail - 1, tail)) if odd_end else (np.where((head < tail) & (head % 2 == 1), head + 1, head), tail)
            head, tail = head // 2, tail // 2
        for target, part in ((sums, parts[0]), (values, parts[1])):
            for p in range(len(target)):
                target[p] += sign**p * (part[p] * (1 + 1e-9) - 3 * part[p + 3] + 3 * part[p + 6] - part[p + 9])
    normal = sums[np.add.outer(np.arange(3), np.arange(3))].transpose(2, 0, 1)
    ends = np.linalg.eigvalsh(normal)
    good = (ends[:, 0] > 0) & (ends[:, 2] < WORST * ends[:, 0])
    out = np.empty(len(own))
    if good.any():
        out[good] = np.linalg.solve(normal[good], values.T[good][:, :, None])[:, 0, 0]
    for i in np.flatnonzero(~good):  # few levels carry the weight, or the trend is drawn out from far away
        at = np.arange(first[i], last[i] + 1)
        count = np.minimum(until[at], start[i] + k) - np.maximum(until[at] - n[at], start[i])
        u = (x[at] - x0[i]) / h[i]
        w = np.sqrt(_tricube(np.abs(u)) * count)
        out[i] = np.linalg.lstsq(np.vander(u, 3, increasing=True) * w[:, None], s[at] / n[at] * w, rcond=None)[0][0]
    return out


def mean_adjusted_noise(df: DataFrame, span: float = 0.3, least: int = 10) -> DataFrame:
    """(source, feature, adjusted): log CV^2 less a local quadratic trend on log mean, within each source; null under `least` usable rows.

    The trend has tricube weights over the nearest span of the rows. Rows are summed by source and log mean first; a task holds the
    distinct log means of a source, about 80 bytes each, and no rows.
    """
    number = lambda c: F.when(F.abs(c) < float("inf"), c)
    rows = df.select(F.col("source").cast("string").alias("source"), "feature", number(F.ln("mean")).alias("_x"), number(F.ln("cv2")).alias("_y"))
    rows = checkpointed(rows.withColumn("_x", F.when(F.col("_y").isNotNull(), F.col("_x"))))
    levels = rows.where("_x IS NOT NULL").groupBy("source", "_x").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        total, trend = int(pdf["n"].sum()), np.full(len(pdf), np.nan)
        if total >= least:
            trend = local_trend(pdf["_x"].to_numpy(), pdf["n"].to_numpy(), pdf["s"].to_numpy(), max(4, int(np.ceil(span * total))))
        return pd.DataFrame({"_source": pd.Series([key[0]] * len(pdf), dtype=object), "_level": pdf["_x"].to_numpy(), "_trend": trend})

    trends = levels.groupBy("source").applyInPandas(fit, "_source string, _level double, _trend double").where("NOT isnan(_trend)")
    out = rows.join(trends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_x") == F.col("_level")), "left")
    return out.select("source", "feature", (F.col("_y") - F.col("_trend")).alias("adjusted"))


def extrinsic_fractions(df: DataFrame, floor: float = 0.1) -> DataFrame:
    """(feature, rho_true, extrinsic, intrinsic, clipped): observed correlations over their attenuation, clipped to 0..1, above the floor.

    df: (feature, rho_obs, attn); joined by feature, so a feature without an attenuation has no row.
    """
    rows = df.where(F.col("attn") >= floor).withColumn("rho_true", F.col("rho_obs") / F.col("attn"))
    e = F.least(F.greatest("rho_true", F.lit(0.0)), F.lit(1.0))
    return rows.select("feature", "rho_true", e.alias("extrinsic"), (1 - e).alias("intrinsic"), ((F.col("rho_true") < 0) | (F.col("rho_true") > 1)).alias("clipped"))


def attenuation(reliabilities: DataFrame) -> DataFrame:
    """(feature, attn): geometric mean of two reliabilities a and b."""
    return reliabilities.select("feature", F.sqrt(F.col("a") * F.col("b")).alias("attn"))
