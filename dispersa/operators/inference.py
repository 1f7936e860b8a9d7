"""Null dispersions, refit tests, eligibility and summaries of inference tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions.stats import benjamini_hochberg
from dispersa.operators.fitting import LOG_PHI, _likelihood, _maximise


def null_dispersions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, dataset, weight, phi) with `null_log2`: the nearest dispersions in log2 with a contrast of zero; null unless all are positive."""
    w = Window.partitionBy(*keys)
    ok = F.bool_and(F.coalesce(F.col("phi") > 0, F.lit(False))).over(w)
    l2 = F.when(F.col("phi") > 0, F.log2("phi"))
    delta, norm = F.sum(F.col("weight") * l2).over(w), F.sum(F.col("weight") * F.col("weight")).over(w)
    return rows.withColumn("null_log2", F.when(ok, F.pow(F.lit(2.0), l2 - F.col("weight") * delta / norm)))


def null_raw_dispersions(rows: DataFrame, keys: list[str], rounds: int = 4) -> DataFrame:
    """rows with `null_raw`: the nearest dispersions that aren't negative and whose contrast is zero.

    Values below zero are held at zero and the others moved again; with up to four datasets a mode four rounds are enough.
    """
    w = Window.partitionBy(*keys)
    out = rows.withColumn("null_raw", F.col("phi").cast("double")).withColumn("_free", F.lit(True))
    for _ in range(rounds):
        delta = F.sum(F.col("weight") * F.col("null_raw")).over(w)
        norm = F.sum(F.when(F.col("_free"), F.col("weight") * F.col("weight")).otherwise(0.0)).over(w)
        out = out.withColumn("_move", F.when(F.col("_free"), F.coalesce(F.try_divide(F.col("weight") * delta, norm), F.lit(0.0))).otherwise(0.0))
        out = out.withColumn("null_raw", F.col("null_raw") - F.col("_move"))
        out = out.withColumn("_free", F.col("_free") & (F.col("null_raw") >= 0)).withColumn("null_raw", F.greatest("null_raw", F.lit(0.0)))
    return out.drop("_free", "_move")


def null_kinetic_dispersions(rows: DataFrame, keys: list[str], a: float, b: float) -> DataFrame:
    """rows (..., dmu) with `null_kinetic`: log2 dispersions moved until a dmu + b dphi is zero with the means held."""
    w = Window.partitionBy(*keys)
    l2 = F.when(F.col("phi") > 0, F.log2("phi"))
    stat = a * F.col("dmu") + b * F.sum(F.col("weight") * l2).over(w)
    norm = b * F.sum(F.col("weight") * F.col("weight")).over(w)
    ok = F.bool_and(F.coalesce(F.col("phi") > 0, F.lit(False))).over(w)
    return rows.withColumn("null_kinetic", F.when(ok, F.pow(F.lit(2.0), l2 - F.col("weight") * stat / norm)))


def weighted_fits(counts: DataFrame, units: DataFrame) -> DataFrame:
    """(dataset, feature, mu, disp, boundary): the root of the weighted moment equation, by bisection on all features of a batch.

    sum w(phi) (r^2 - A - phi B) = 0 with the inverse variances of the negative binomial as weights; without a positive root
    the fit is at the boundary. Zeros enter through the dataset's distinct exposures.
    """
    from dispersa.operators.fitting import exposure_spectrum, sufficient

    stats = sufficient(counts, units)
    spectrum = counts.sparkSession.sparkContext.broadcast(exposure_spectrum(units))
    rows = counts.join(units.select("dataset", "unit", "expo"), ["dataset", "unit"])
    arrays = rows.groupBy("dataset", "feature").agg(F.collect_list(F.col("y").cast("double")).alias("ys"), F.collect_list("expo").alias("es"))
    work = arrays.join(stats.select("dataset", "feature", "mu", "se", "se2"), ["dataset", "feature"])

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for dataset, mu, se, se2, ys, es in pdf[["dataset", "mu", "se", "se2", "ys", "es"]].itertuples(index=False):
                ef, en = spectrum.value[dataset]
                y, e = np.asarray(ys), np.asarray(es)

                def terms(x, m2=mu * mu * se2, se=se, mu=mu):
                    m, p = mu * x, x / se
                    return m, m * (1 - p), m * m * (1 - 2 * p) + p * p * m2

                m0, a0, b0 = terms(ef)
                m1, a1, b1 = terms(e)

                def g(phi, m0=m0, a0=a0, b0=b0, m1=m1, a1=a1, b1=b1, y=y, en=en):
                    w = lambda m: 1 / ((1 + phi * m) * (1 + phi + phi * m * (1 + 3 * phi)))
                    zero = (en * w(m0) * (m0 * m0 - a0 - phi * b0)).sum()
                    return zero + (w(m1) * ((y - m1) ** 2 - m1 * m1)).sum()

                low, high = 0.0, float(np.exp(LOG_PHI[1]))
                if g(0.0) <= 0:
                    out.append(0.0)
                    continue
                if g(high) >= 0:
                    out.append(high)
                    continue
                for _ in range(80):
                    mid = (low + high) / 2
                    low, high = (mid, high) if g(mid) > 0 else (low, mid)
                out.append((low + high) / 2)
            yield pd.DataFrame({"dataset": pdf["dataset"], "feature": pdf["feature"], "mu": pdf["mu"], "disp": out, "boundary": [int(x == 0) for x in out]})

    return work.mapInPandas(fit, "dataset string, feature string, mu double, disp double, boundary int")


#: Counts up to which a unit's chances are listed; units drawn one by one are drawn so many together.
LISTED, SINGLY = 65_536, 20_000


def _chances(mean: float, phi: float) -> np.ndarray:
    """Chances of the counts 0, 1, ... of a negative binomial, until what is left is nothing in doubles."""
    top = int(np.ceil(mean + 12 * np.sqrt(mean + phi * mean * mean) + 40 * (1 + phi * mean)))
    if top > LISTED:
        return np.zeros(0)
    y = np.arange(top)
    steps = np.log((1 + phi * y) * mean / ((1 + phi * mean) * (y + 1)))
    p = np.exp(np.concatenate([[0.0], np.cumsum(steps)]) - np.log1p(phi * mean) / phi)
    return p / p.sum()


def drawn_counts(rng: np.random.Generator, n: int, mean: float, phi: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(draw, count, units): how many of n units of one mean have each count, in `size` draws; the work grows with the counts, not with n."""
    p = _chances(mean, phi)
    if 0 < len(p) <= n:
        cells = rng.multinomial(n, p, size)
        draw, y = np.nonzero(cells)
        return draw, y, cells[draw, y]
    out = []
    for low in range(0, n, SINGLY):
        y = rng.poisson(mean * rng.gamma(1 / phi, phi, (size, min(SINGLY, n - low))))
        for draw, own in enumerate(y):
            values, cells = np.unique(own, return_counts=True)
            out.append((np.full(len(values), draw), values, cells))
    return tuple(np.concatenate(x) for x in zip(*out))


def _added_cells(draw: np.ndarray, v: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of equal draw and value together, ascending by value."""
    values, code = np.unique(v, return_inverse=True)
    many = int(draw.max(initial=0)) + 1
    both, at = np.unique(code * many + draw, return_inverse=True)
    return both % many, values[both // many].astype(float), np.bincount(at, cells, len(both))


def simulated_dispersions(rng: np.random.Generator, mu: float, phi: float, ef: np.ndarray, en: np.ndarray, size: int) -> np.ndarray:
    """log2 dispersions refitted to `size` draws of a dataset with exposures ef of en units each; -inf at the boundary."""
    drawn = [drawn_counts(rng, int(n), mu * e, phi, size) for e, n in zip(ef, en)]
    at = np.repeat(np.arange(len(ef)), [len(x[0]) for x in drawn])
    draw, y, cells = (np.concatenate([x[i] for x in drawn]) for i in range(3))
    y = y.astype(float)
    table = lambda w: np.bincount(draw * len(ef) + at, w, size * len(ef)).reshape(size, -1)
    sums, squares = table(cells * y), table(cells * y * y)
    fit = np.maximum(sums.sum(axis=1) / (ef @ en), 1e-12)
    mean = fit[:, None] * ef
    slope = (squares - 2 * mean * sums + en * mean**2).sum(axis=1) - mean @ en + (mean**2) @ en / (mean @ en)
    some = np.nonzero(sums)
    rows = (*_added_cells(draw[y > 0], y[y > 0], cells[y > 0]), some[0], ef[some[1]], sums[some])
    best = _maximise(lambda x: _likelihood(np.exp(x), rows, fit, ef, en), np.full(size, LOG_PHI[0]), np.full(size, LOG_PHI[1]))
    return np.where(slope > 0, best / np.log(2), -np.inf)


def parametric_p(fits: DataFrame, units: DataFrame, groups: dict[str, float], sims: int, seed: int, block: int = 50) -> DataFrame:
    """(feature, obs, p, n): test of a log2 dispersion contrast against counts drawn from the fits with that contrast set to zero.

    fits (dataset, feature, mu, disp) hold the datasets of `groups` (dataset -> weight) with positive dispersions. Each feature's
    draws are cut into blocks that are seeded by feature and block; a task draws how often each count occurs at each distinct exposure, refits
    and returns how many draws were as extreme, so no draw is ever moved and no unit is drawn on its own where many share an exposure.
    """
    spark = fits.sparkSession
    from dispersa.operators.fitting import exposure_spectrum

    names = list(groups)
    weights = np.array([groups[n] for n in names])
    spectrum = spark.sparkContext.broadcast(exposure_spectrum(units.where(F.col("dataset").isin(names))))
    table = spark.createDataFrame(list(groups.items()), "dataset string, weight double")
    nulls = null_dispersions(fits.join(F.broadcast(table), "dataset").select("feature", "dataset", "weight", "mu", F.col("disp").alias("phi")), ["feature"])
    wide = nulls.where("null_log2 IS NOT NULL").groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("dataset", F.struct("mu", "null_log2")))).alias("m"), F.sum(F.col("weight") * F.log2("phi")).alias("obs"), F.count("*").alias("k")
    ).where(F.col("k") == len(names))
    tasks = wide.select("feature", "obs", "m", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // block))).alias("b")).repartition(4 * spark.sparkContext.defaultParallelism, "feature", "b")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for pdf in it:
            more, n = [], []
            for feature, obs, m, b in pdf[["feature", "obs", "m", "b"]].itertuples(index=False):
                rng = np.random.Generator(np.random.Philox(xxh64_intdigest(f"{seed}/{feature}/{b}".encode())))
                size = min(block, sims - b * block)
                logs = np.zeros((size, len(names)))
                for j, name in enumerate(names):
                    logs[:, j] = simulated_dispersions(rng, m[name]["mu"], m[name]["null_log2"], *spectrum.value[name], size)
                with np.errstate(invalid="ignore"):
                    value = (logs * weights).sum(axis=1)
                value = value[~np.isnan(value)]
                more.append(int((np.abs(value) >= abs(obs)).sum()))
                n.append(len(value))
            yield pd.DataFrame({"feature": pdf["feature"], "obs": pdf["obs"], "more": more, "n": n})

    got = tasks.mapInPandas(run, "feature string, obs double, more long, n long")
    return got.groupBy("feature", "obs").agg(((1 + F.sum("more")) / (1 + F.sum("n"))).alias("p"), F.sum("n").alias("n"))


def eligibility(fits: DataFrame, groups: DataFrame, info: DataFrame) -> DataFrame:
    """(feature, mode, mean_ok, raw_ok, log_ok, poisson_like): what each mode's datasets allow.

    mean: an informative mean in each; raw: class 1 or 2 in each; log: class 1 in each. info (dataset, feature, info_ok).
    """
    rows = fits.join(info, ["dataset", "feature"], "left").join(F.broadcast(groups), "dataset")
    kind = F.coalesce(F.col("class"), F.lit(0))
    per = rows.groupBy("feature", "mode").agg(
        F.first("k").alias("k"), F.count_if(F.coalesce("info_ok", F.lit(False)) & F.col("mu").isNotNull()).alias("m"), F.count_if(kind.isin(1, 2)).alias("r"),
        F.count_if(kind == 1).alias("l"), F.count_if(kind == 2).alias("z"),
    )
    k = F.col("k")
    return per.select("feature", "mode", (F.col("m") == k).alias("mean_ok"), (F.col("r") == k).alias("raw_ok"), (F.col("l") == k).alias("log_ok"), (F.col("z") > 0).alias("poisson_like"))


def exclusion_counts(fits: DataFrame, groups: DataFrame) -> DataFrame:
    """(mode, features, eligible, no_fit, uninformative, near_zero): each feature once, under the first reason against a log2 contrast."""
    rows = fits.join(F.broadcast(groups), "dataset").groupBy("feature", "mode").agg(
        F.first("k").alias("k"), F.count("class").alias("n"), F.bool_or(F.col("class") == 3).alias("u"), F.bool_or(F.col("class") == 2).alias("z")
    )
    why = F.when(F.col("n") < F.col("k"), "no_fit").when(F.col("u"), "uninformative").when(F.col("z"), "near_zero").otherwise("eligible")
    names = ("eligible", "no_fit", "uninformative", "near_zero")
    return rows.withColumn("why", why).groupBy("mode").agg(F.count("*").alias("features"), *[F.count_if(F.col("why") == n).alias(n) for n in names])


def status_table(grid: DataFrame, estimates: DataFrame, tests: DataFrame, sig: float = 0.05) -> DataFrame:
    """grid (feature, mode, quantity, eligible) with run, est_ok, ci_ok, test_ok, q and sig from estimates (.., est, se) and tests (.., p, q)."""
    keys = ["feature", "mode", "quantity"]
    out = grid.join(estimates.select(*keys, "est", "se", F.lit(True).alias("_run")), keys, "left").join(tests.select(*keys, "p", "q"), keys, "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.select(
        *keys, "eligible", F.coalesce("_run", F.lit(False)).alias("run"), finite("est").alias("est_ok"), finite("se").alias("ci_ok"), finite("p").alias("test_ok"), "q",
        F.coalesce(F.col("q") < sig, F.lit(False)).alias("sig"),
    )


def status_tally(status: DataFrame) -> DataFrame:
    flags = ("eligible", "run", "est_ok", "ci_ok", "test_ok", "sig")
    return status.groupBy("quantity", "mode").agg(*[F.count_if(f).alias(f) for f in flags])


def zero_shares(draws: DataFrame, keys: list[str], value: str, flag: float = 0.025) -> DataFrame:
    """(keys, zero, flagged): share of draws at a zero dispersion, -Infinity in log2, and whether it is over `flag`."""
    z = F.avg((F.abs(value) == float("inf")).cast("int"))
    return draws.where(F.col(value).isNotNull()).groupBy(*keys).agg(z.alias("zero")).withColumn("flagged", F.col("zero") > flag)


def floor_table(df: DataFrame, attenuation: str, se: str, floors: DataFrame) -> DataFrame:
    """(floor, n, median_se) of rows at or above each floor of a short table."""
    rows = df.join(F.broadcast(floors), F.col(attenuation) >= F.col("floor"), "right")
    return rows.groupBy("floor").agg(F.count(se).alias("n"), F.percentile(se, 0.5).alias("median_se"))


def mixture_power(nulls: DataFrame, alternatives: DataFrame, alpha: float, share: float, mixtures: int, seed: int) -> DataFrame:
    """(power): mean share of alternatives found at a false discovery rate, over mixtures of the nulls with hashed samples of the alternatives.

    nulls and alternatives (id, p). A sample takes the alternatives with the least hashes of a mixture.
    """
    n = nulls.count()
    take = min(n, int(round(n * share / (1 - share))))
    mix = nulls.sparkSession.range(mixtures).withColumnRenamed("id", "mix")
    order = Window.partitionBy("mix").orderBy(F.xxhash64(F.lit(seed), "mix", "id"), "id")
    chosen = alternatives.select("id", "p").join(F.broadcast(mix)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= take).select("mix", "p", F.lit(True).alias("alt"))
    rows = nulls.select("p").join(F.broadcast(mix)).select("mix", "p", F.lit(False).alias("alt")).union(chosen)
    q = benjamini_hochberg(rows, "p", ["mix"])
    return q.where("alt AND q IS NOT NULL").groupBy("mix").agg(F.avg((F.col("q") < alpha).cast("int")).alias("w")).agg(F.avg("w").alias("power"))


def calibration(tests: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(keys, n, below_05, below_20): shares of small p-values where the null is true."""
    rows = tests.where(F.col(p).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(p) < 0.05).cast("int")).alias("below_05"), F.avg((F.col(p) < 0.2).cast("int")).alias("below_20"))
