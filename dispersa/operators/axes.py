"""Resampled correlation tables and their leading axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions import tails
from dispersa.operators.classes import outer_groups

def bootstrap_pairs(residuals: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, j, n, mean, se): correlations of features over resamples of units, from residuals (unit, feature, r) and weights (draw, unit, w).

    Rows of a draw come together one after the other; a task keeps one Gram matrix, that of the draw at hand, and the
    sum and sum of squares of its draws' correlations, and returns those once.
    """
    vectors = residuals.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("feature", "r"))).alias("v")).select("unit", F.col("v.feature").alias("f"), F.col("v.r").alias("v"))
    rows = weights.join(vectors, "unit").select("draw", "w", "f", "v").repartition("draw").sortWithinPartitions("draw")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw, names, state, sums, count = None, None, None, None, 0

        def close():
            nonlocal sums, count
            w, s, g = state
            cov = g / w - np.outer(s / w, s / w)
            d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
            r = (cov / d / d[:, None])[np.triu_indices(len(d), 1)]
            sums = (r.copy(), r * r) if sums is None else (sums[0] + r, sums[1] + r * r)
            count += 1

        for pdf in it:
            for key, part in pdf.groupby("draw", sort=False):
                x, w = np.stack(part["v"].to_numpy()), part["w"].to_numpy(float)
                names = list(part["f"].iloc[0])
                add = (w.sum(), w @ x, (x * w[:, None]).T @ x)
                if key != draw and state is not None:
                    close()
                    state = None
                state = add if state is None else tuple(a + b for a, b in zip(state, add, strict=True))
                draw = key
        if state is not None:
            close()
            i, j = np.triu_indices(len(names), 1)
            f = np.array(names)
            yield pd.DataFrame({"i": f[i], "j": f[j], "n": count, "s": sums[0], "q": sums[1]})

    parts = rows.mapInPandas(run, "i string, j string, n long, s double, q double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return parts.select("i", "j", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))).alias("se"))


def normal_p(df: DataFrame, est: str, se: str) -> DataFrame:
    """df with z = est / se and its two-sided normal p; null without a positive error."""
    z = F.when(F.col(se) > 0, F.col(est) / F.col(se))
    return df.withColumn("z", z).withColumn("p", tails.normal_p(F.col("z")))


def candidate_axes(axes: DataFrame, least_share: float = 0.01, least_participation: float = 10.0) -> DataFrame:
    """(rank, eigenvalue, share, participation) of axes with enough variance, spread over enough features: 1 / sum v^4."""
    g = axes.groupBy("rank").agg(F.first("eigenvalue").alias("eigenvalue"), F.first("share").alias("share"), (1 / F.sum(F.pow("v", F.lit(4)))).alias("participation"))
    return g.where((F.col("share") >= least_share) & (F.col("participation") >= least_participation))


def rank_matched_p(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(rank, p): add-one p of squared eigenvalues (rank, value) against null draws' (draw, rank, value) of the same rank."""
    rows = observed.select("rank", F.col("value").alias("obs")).join(null.select("rank", "value"), "rank", "left")
    return rows.groupBy("rank").agg(((1 + F.count_if(F.col("value") >= F.col("obs"))) / (1 + F.count("value"))).alias("p"))


def signed_sets(df: DataFrame, feature: str, est: str, q: str, name: str, sig: float = 0.05) -> DataFrame:
    """(set_name, feature, ord): significant features up and down, the largest |est| first."""
    ok = df.where((F.col(q) < sig) & (F.col(est) != 0))
    label = F.concat(F.lit(name), F.when(F.col(est) > 0, "_up").otherwise("_down"))
    order = Window.partitionBy("set_name").orderBy(F.desc(F.abs(est)), "feature")
    return ok.select(label.alias("set_name"), F.col(feature).alias("feature"), est).withColumn("ord", F.row_number().over(order)).drop(est)


def level_sets(df: DataFrame, feature: str, score: str, name: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(set_name, feature): features of low, average and high score as sets of an enrichment; features without a score are in none."""
    rows = outer_groups(df, score, low, high).where("level IS NOT NULL")
    return rows.select(F.concat(F.lit(f"{name}_"), "level").alias("set_name"), F.col(feature).alias("feature"))


def class_sets(df: DataFrame, feature: str, group: str, est: str, q: str, sig: float = 0.05) -> DataFrame:
    """(set_name, feature): each class by the sign of a significant total, both without one."""
    sign = F.when((F.col(q) < sig) & (F.col(est) > 0), ".up").when((F.col(q) < sig) & (F.col(est) < 0), ".down")
    return df.where(F.col(group).isNotNull() & sign.isNotNull()).select(F.concat(F.col(group), sign).alias("set_name"), F.col(feature).alias("feature"))


def typed_pairs(pairs: DataFrame, poles: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with `type`: within_POS, within_NEG or cross by the features' poles (feature, pole); others are null."""
    a, b = poles.select(F.col("feature").alias("i"), F.col("pole").alias("_a")), poles.select(F.col("feature").alias("j"), F.col("pole").alias("_b"))
    out = pairs.join(a, "i", "left").join(b, "j", "left")
    kind = F.when(F.col("_a") == F.col("_b"), F.concat(F.lit("within_"), "_a")).when(F.col("_a") != F.col("_b"), "cross")
    return out.withColumn("type", kind).drop("_a", "_b")
