"""Negative-binomial dispersion of each (dataset, feature) from sparse counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_PHI = (-15.0, 4.0)  # search range of log phi
LONG = 512  # counts above are summed by an integral
CHI_90 = 2.7055434541  # fixed value: upper 10 % point of chi-squared with one degree of freedom
FITS = "dataset string, feature string, disp_app double, lrt double, upper double, hit_range int"


def sufficient(counts: DataFrame, units: DataFrame) -> DataFrame:
    """(dataset, feature, n, Se, Se2, Se3, sy, sy2, sye, n_expr, mu, slope0): sums over the stored rows and over all units.

    Zeros aren't stored; they enter through the dataset's sums of exposures alone.
    """
    e = F.col("expo")
    all_units = units.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(e).alias("se"), F.sum(e * e).alias("se2"), F.sum(e * e * e).alias("se3"))
    y = F.col("y").cast("double")
    rows = counts.join(units.select("dataset", "unit", "expo"), ["dataset", "unit"])
    per = rows.groupBy("dataset", "feature").agg(F.sum(y).alias("sy"), F.sum(y * y).alias("sy2"), F.sum(y * e).alias("sye"), F.count("*").alias("n_expr"))
    out = per.join(F.broadcast(all_units), "dataset").withColumn("mu", F.col("sy") / F.col("se"))
    mu, se, se2 = F.col("mu"), F.col("se"), F.col("se2")
    return out.withColumn("slope0", F.col("sy2") - 2 * mu * F.col("sye") + mu * mu * se2 - mu * se + mu * se2 / se)


def moment_fit(stats: DataFrame) -> DataFrame:
    """(dataset, feature, mu, disp_moment): the signed moment estimate with unit weights, from the sums alone."""
    mu, se, se2, se3 = (F.col(c) for c in ("mu", "se", "se2", "se3"))
    up = F.col("sy2") - 2 * mu * F.col("sye") + mu * mu * se2 - mu * (se - se2 / se)
    down = mu * mu * (se2 - 2 * se3 / se + se2 * se2 / (se * se))
    return stats.select("dataset", "feature", "mu", F.try_divide(up, down).alias("disp_moment"))


def _log_rises(phi: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of log(1 + phi j) over 1 <= j < y for each entry, y ascending: term by term up to LONG, beyond by the integral and its end corrections."""
    out = np.zeros(len(y))
    for j in range(1, int(min(y.max(initial=0), LONG))):
        k = np.searchsorted(y, j, "right")
        out[k:] += np.log1p(phi[k:] * j)
    k = np.searchsorted(y, LONG, "right")
    if k < len(y):
        p, ends = phi[k:], (float(LONG), y[k:])
        whole = [((1 + p * x) * np.log1p(p * x) - p * x) / p - np.log1p(p * x) / 2 + p / (1 + p * x) / 12 for x in ends]
        out[k:] += whole[1] - whole[0]
    return out


def _likelihood(phi: np.ndarray, rows, mu: np.ndarray, ef: np.ndarray, en: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted log-likelihood of each feature at its phi, without terms that phi isn't in.

    rows: (feature, y, cells) of each distinct count, ascending by y, and (feature, exposure, summed y) of each distinct exposure; ef, en:
    the dataset's distinct exposures and their numbers of units. Counts are integers, so the gamma functions become sums of logs over j < y.
    """
    of_y, y, cells, of_e, e, sums = rows
    safe = np.maximum(phi, 1e-300)
    steps = np.bincount(of_y, cells * _log_rises(safe[of_y], y), len(phi)) - np.bincount(of_e, sums * np.log1p(safe[of_e] * mu[of_e] * e), len(phi))
    t = safe * mu
    tail, info = np.zeros(len(phi)), np.zeros(len(phi))
    width = max(1, 4_000_000 // max(1, len(phi)))  # exposures at a time: 32 MB a table
    for a in range(0, len(ef), width):
        te = t[:, None] * ef[None, a : a + width]
        tail += np.log1p(te) @ en[a : a + width]
        info += (ef[None, a : a + width] / (1 + te)) @ en[a : a + width]
    out = steps - tail / safe - 0.5 * np.log(mu * info)
    flat = phi == 0
    if flat.any():
        out[flat] = -(mu[flat] * (ef @ en)) - 0.5 * np.log(mu[flat] * (ef @ en))
    return out


def _maximise(f, low: np.ndarray, high: np.ndarray, width: float = 1e-7) -> np.ndarray:
    """Golden section on all features at once, down to intervals of `width`; one evaluation a round."""
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


def _fit_batch(pdf: pd.DataFrame, spectrum: dict[str, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    out = []
    for dataset, part in pdf.groupby("dataset"):
        ef, en = spectrum[dataset]
        of = [np.repeat(np.arange(len(part)), part[c].str.len()) for c in ("ys", "es")]
        y, cells, e, sums = (np.concatenate(part[c].to_list()).astype(float) for c in ("ys", "ns", "es", "ss"))
        up = np.argsort(y, kind="stable")
        rows = (of[0][up], y[up], cells[up], of[1], e, sums)
        mu = part["mu"].to_numpy(float)

        def ll(log_phi, rows=rows, mu=mu, ef=ef, en=en):
            return _likelihood(np.exp(log_phi), rows, mu, ef, en)

        low, high = np.full(len(part), LOG_PHI[0]), np.full(len(part), LOG_PHI[1])
        best = _maximise(ll, low, high)
        bound = part["slope0"].to_numpy() <= 0
        phi = np.where(bound, 0.0, np.exp(best))
        top = _likelihood(phi, rows, mu, ef, en)
        lrt = np.where(bound, 0.0, 2 * (top - _likelihood(np.zeros(len(phi)), rows, mu, ef, en)))
        # first crossing of the likelihood's drop on steps of one half, then bisection
        a = np.maximum(np.where(bound, LOG_PHI[0], best), LOG_PHI[0])
        done, lo, hi = np.zeros(len(phi), bool), a.copy(), high.copy()
        x = a
        while not done.all() and (x < LOG_PHI[1]).any():
            y = np.minimum(x + 0.5, LOG_PHI[1])
            over = ~done & (2 * (top - ll(y)) > CHI_90)
            lo, hi, done = np.where(over, x, lo), np.where(over, y, hi), done | over
            x = y
        for _ in range(29):  # from one half to 1e-9
            mid = (lo + hi) / 2
            over = 2 * (top - ll(mid)) > CHI_90
            lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        upper = np.where(done, np.exp(hi), np.exp(LOG_PHI[1]))
        edge = np.minimum(np.abs(best - LOG_PHI[0]), np.abs(best - LOG_PHI[1])) < 1e-3
        out.append(pd.DataFrame({"dataset": dataset, "feature": part["feature"].to_numpy(), "disp_app": phi, "lrt": lrt, "upper": upper, "hit_range": np.where(bound, 0, edge).astype("int32")}))
    return pd.concat(out, ignore_index=True)


def exposure_spectrum(units: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each dataset its distinct exposures and how many units have each.

    Libraries are integers and an exposure is a library over a constant, so there are no more rows than distinct library
    sizes, 16 bytes each, however many units there are.
    """
    got = units.groupBy("dataset", "expo").agg(F.count("*").alias("n")).toPandas()
    return {d: (p["expo"].to_numpy(float), p["n"].to_numpy(float)) for d, p in got.groupby("dataset")}


def fit_dispersions(counts: DataFrame, units: DataFrame, corrections: DataFrame | None = None, eps: float = 0.1) -> DataFrame:
    """The fit table of all datasets in one job.

    One row for each (dataset, feature) with counts: mu, disp (corrected, cut at 0), theta, disp_app, disp_raw, boundary,
    converged, hit_range, lrt, disp_upper, mbar, class, n_expr and the derived var, fano, cv, bsize. `corrections`
    (dataset, share_r, share_sub) hold the share terms. Features are partitioned by key; each task
    maximises the likelihood of a batch of features together.
    """
    stats = sufficient(counts, units)
    spectrum = counts.sparkSession.sparkContext.broadcast(exposure_spectrum(units))
    rows = counts.join(units.select("dataset", "unit", "expo"), ["dataset", "unit"])
    # the likelihood needs how often a count occurs and what is counted at an exposure: a feature's arrays hold distinct values, not cells
    y, e = F.col("y").cast("double"), F.col("expo").cast("double")
    each = F.explode(F.array(F.struct(F.lit(True).alias("count"), y.alias("v"), F.lit(1.0).alias("w")), F.struct(F.lit(False).alias("count"), e.alias("v"), y.alias("w")))).alias("c")
    tables = rows.select("dataset", "feature", each).groupBy("dataset", "feature", "c.count", "c.v").agg(F.sum("c.w").alias("w"))
    pair = F.struct("v", "w")
    lists = [F.sort_array(F.collect_list(F.when(of, pair))).alias(name) for name, of in (("_y", F.col("count")), ("_e", ~F.col("count")))]
    arrays = tables.groupBy("dataset", "feature").agg(*lists)
    arrays = arrays.select("dataset", "feature", F.col("_y.v").alias("ys"), F.col("_y.w").alias("ns"), F.col("_e.v").alias("es"), F.col("_e.w").alias("ss"))
    work = arrays.join(stats.select("dataset", "feature", "mu", "slope0"), ["dataset", "feature"])

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield _fit_batch(pdf, spectrum.value)

    fitted = work.mapInPandas(fit, FITS)
    out = stats.join(fitted, ["dataset", "feature"])
    if corrections is None:
        out = out.withColumn("share_r", F.lit(0.0)).withColumn("share_sub", F.lit(0.0))
    else:
        out = out.join(F.broadcast(corrections), "dataset", "left").na.fill(0.0, ["share_r", "share_sub"])
    raw = corrected("disp_app")
    out = out.withColumn("disp_raw", raw).withColumn("disp", F.greatest(raw, F.lit(0.0))).withColumn("disp_upper", F.greatest(corrected("upper"), F.lit(0.0)))
    out = out.withColumn("mbar", F.col("mu") * F.col("se") / F.col("n")).withColumn("boundary", (F.col("disp") == 0).cast("int")).withColumn("converged", F.lit(1))
    out = out.withColumn("class", informativeness(F.col("lrt"), F.col("disp"), F.col("disp_upper"), F.col("mbar"), eps=eps))
    phi, mu = F.col("disp"), F.col("mu")
    return out.select(
        "dataset", "feature", "mu", "disp", F.when(phi > 0, 1 / phi).otherwise(F.lit(float("inf"))).alias("theta"), "disp_app", "disp_raw", "boundary", "converged",
        "hit_range", "lrt", "disp_upper", "mbar", "class", "n_expr", (mu + mu * mu * phi).alias("var"), (1 + mu * phi).alias("fano"),
        F.sqrt(phi + 1 / mu).alias("cv"), (mu * phi).alias("bsize"),
    )


def corrected(phi: str) -> Column:
    """A dispersion less the share terms of its dataset."""
    return (F.col(phi) - F.col("share_r")) / (1 + F.col("share_r")) - F.col("share_sub")


def informativeness(lrt: Column, phi: Column, upper: Column, mbar: Column, critical: float = CHI_90, eps: float = 0.1) -> Column:
    """1 resolved above zero, 2 near zero, 3 uninformative; null without a fit."""
    return F.when(lrt.isNull(), None).when((lrt > critical) & (phi > 0), 1).when(upper * mbar < eps, 2).otherwise(3)


def class_tally(fits: DataFrame) -> DataFrame:
    """(dataset, class1, class2, class3, none, at_zero, at_range)."""
    return fits.groupBy("dataset").agg(
        *[F.count_if(F.col("class") == k).alias(f"class{k}") for k in (1, 2, 3)], F.count_if(F.col("class").isNull()).alias("none"),
        F.count_if(F.col("disp") == 0).alias("at_zero"), F.count_if(F.col("hit_range") == 1).alias("at_range"),
    )


def fit_status(mu: Column, disp: Column, n: Column) -> Column:
    """missing, no_information, failed, zero_boundary or positive; the first that applies."""
    return F.when(n.isNull(), "missing").when(mu == 0, "no_information").when(disp.isNull(), "failed").when(disp == 0, "zero_boundary").otherwise("positive")


def class_sets(fits: DataFrame, thresholds: DataFrame, classes: list[int]) -> DataFrame:
    """(critical, eps, n): features whose class is among `classes` in every dataset, at each row of thresholds."""
    at = fits.join(F.broadcast(thresholds))
    kind = F.when(F.col("lrt").isNull(), None).when((F.col("lrt") > F.col("critical")) & (F.col("disp") > 0), 1).when(F.col("disp_upper") * F.col("mbar") < F.col("eps"), 2).otherwise(3)
    per = at.groupBy("critical", "eps", "feature").agg(F.bool_and(F.coalesce(kind.isin(classes), F.lit(False))).alias("ok"))
    return per.groupBy("critical", "eps").agg(F.count_if("ok").alias("n"))


def reliability(fits: DataFrame) -> DataFrame:
    """(feature, reliability): the least phi mu / (1 + phi mu) over the datasets."""
    x = F.col("disp") * F.col("mu")
    return fits.groupBy("feature").agg(F.min(x / (1 + x)).alias("reliability"))


def allele_components(counts: DataFrame, units: DataFrame, terms: DataFrame, alleles: tuple[str, str] = ("HYB.SC", "HYB.SE")) -> DataFrame:
    """(feature, pi, sigma_d, sigma_q, delta, delta_raw, share_sub): shared and private noise of two alleles of one unit.

    The star estimators are means over all units of products and squares of scaled counts; zeros add nothing to them,
    so sums over the stored counts and the number of units are enough.
    """
    wide = counts.where(F.col("dataset").isin(*alleles)).groupBy("feature", "unit")
    wide = wide.agg(F.sum(F.when(F.col("dataset") == alleles[0], F.col("y")).otherwise(0)).alias("yc"), F.sum(F.when(F.col("dataset") == alleles[1], F.col("y")).otherwise(0)).alias("ye"))
    expo = units.where(F.col("dataset").isin(*alleles)).groupBy("unit").agg(F.first("expo").alias("o"))
    total = expo.agg(F.count("*").alias("n"), F.sum("o").alias("so"))
    o2 = F.col("o") * F.col("o")
    s = wide.join(expo, "unit").groupBy("feature").agg(
        F.sum("yc").alias("c"), F.sum("ye").alias("e"), F.sum(F.col("yc") * F.col("ye") / o2).alias("ce"), F.sum(F.col("yc") * F.col("yc") / o2).alias("cc"),
        F.sum(F.col("ye") * F.col("ye") / o2).alias("ee"), F.sum(F.col("yc") / o2).alias("c1"), F.sum(F.col("ye") / o2).alias("e1"),
    )
    s = s.join(F.broadcast(total)).join(F.broadcast(terms.select("cbar", "var_c", "r_c", "r_e"))).where("c > 0 AND e > 0")
    n, mc, me = F.col("n"), F.col("c") / F.col("so"), F.col("e") / F.col("so")
    both = F.col("ce") / (mc * me) / n
    square = (F.col("cc") / (mc * mc) + F.col("ee") / (me * me)) / n - 2 * both
    shot = 0.5 * (F.col("c1") / (mc * mc) + F.col("e1") / (me * me)) / n
    eta, cross = (F.col("r_c") + F.col("r_e")) / 2, F.sqrt(F.col("r_c") * F.col("r_e"))
    s = s.withColumn("_d", both / (1 - cross) - 1)
    s = s.withColumn("_q", (0.5 * square - shot - (eta + cross) * (1 + F.col("_d"))) / (1 + eta))
    s = s.withColumn("sigma_d", F.greatest("_d", F.lit(0.0))).withColumn("sigma_q", F.greatest("_q", F.lit(0.0))).withColumn("pi", F.col("c") / (F.col("c") + F.col("e")))
    pi, sd, sq, cbar = F.col("pi"), F.col("sigma_d"), F.col("sigma_q"), F.col("cbar")
    wsq = pi * pi + (1 - pi) * (1 - pi)
    w = pi / cbar - (1 - pi) / (1 - cbar)
    delta = F.when(sd + sq > 0, F.log2((sd + sq) / (sd + wsq * sq))).otherwise(0.0)
    sub = F.col("var_c") * ((1 + sd) * w * w + sq * (pi * pi / (cbar * cbar) + (1 - pi) * (1 - pi) / ((1 - cbar) * (1 - cbar))))
    return s.select("feature", "pi", "sigma_d", "sigma_q", delta.alias("delta"), ((1 - wsq) * sq).alias("delta_raw"), sub.alias("share_sub"))
