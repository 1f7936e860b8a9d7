"""Correlations of two values of a feature over the same units, with resampling errors on a stratified sample of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.operators.resampling import bootstrap_weights, hashed_pick, hashed_weights

#: Units of a stratum that a task holds at a time, each with a value of every feature.
UNITS = 4096


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with `bin` 1..bins: between quantiles of the value, upper ends within; rows without a finite value are left out.

    Quantiles that coincide leave bins between them empty.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    cuts = rows.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return rows.join(F.broadcast(cuts)).withColumn("bin", 1 + below).drop("_cuts")  # one row of bins - 1 numbers


def stratified_sample(df: DataFrame, key: str, stratum: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows of each stratum, those with the least hashes of (seed, key), the same under any partitioning."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def _block_sums(draws: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(values: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if values.empty or weights.empty:
            return pd.DataFrame({c: [] for c in ("feature", "draw", "w", "a", "b", "aa", "bb", "ab")})
        table = np.zeros((draws + 1, UNITS))
        table[0] = 1  # the data as they are
        for draw, w in zip(weights["draw"], weights["w"]):
            w = np.frombuffer(w, np.int32)
            table[draw, : len(w)] += w
        out = []
        for feature, at, a, b in zip(values["feature"], values["pos"], values["a"], values["b"]):
            a, b = np.asarray(a, float), np.asarray(b, float)
            sums = table[:, np.asarray(at) % UNITS] @ np.column_stack([np.ones(len(a)), a, b, a * a, b * b, a * b])
            out.append(pd.DataFrame({"feature": feature, "draw": np.arange(draws + 1), **dict(zip(("w", "a", "b", "aa", "bb", "ab"), sums.T))}))
        return pd.concat(out)

    return run


def _block_weights(units: DataFrame, draws: int, seed: int, pick) -> DataFrame:
    """(ws, wb, draw, w): how often a draw takes each position of a block of UNITS, as 32-bit integers.

    Draws that hashed_pick makes are found in tasks, each with a stratum's weights in one draw at a time, and leave as a row a block: no row of a
    unit and a draw is shuffled.
    """
    strata = units.select("stratum", "n").distinct()
    schema = "ws int, wb long, draw int, w binary"
    if pick is hashed_pick:
        runs = strata.select(F.col("stratum").cast("int").alias("stratum"), "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))

        def found(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for stratum, n, draw in zip(pdf["stratum"], pdf["n"], pdf["draw"]):
                    w = next(iter(hashed_weights(seed, [int(draw)], int(n)))).astype(np.int32)
                    yield pd.DataFrame({"ws": stratum, "wb": np.arange(-(-len(w) // UNITS)), "draw": draw, "w": [w[i : i + UNITS].tobytes() for i in range(0, len(w), UNITS)]})

        return runs.repartition(min(draws, 4 * units.sparkSession.sparkContext.defaultParallelism)).mapInPandas(found, schema)
    block = F.floor(F.col("pos") / UNITS)
    lists = bootstrap_weights(strata, draws, seed, pick).groupBy(F.col("stratum").cast("int").alias("ws"), block.alias("wb"), "draw").agg(F.collect_list("pos").alias("pos"), F.collect_list("w").alias("w"))

    def dense(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"ws": pdf["ws"], "wb": pdf["wb"], "draw": pdf["draw"], "w": [np.bincount(np.asarray(at) % UNITS, w, UNITS).astype(np.int32).tobytes() for at, w in zip(pdf["pos"], pdf["w"])]})

    return lists.mapInPandas(dense, schema)


def draw_correlations(values: DataFrame, units: DataFrame, draws: int, seed: int = 1, pick=hashed_pick) -> DataFrame:
    """(feature, draw, r): correlation of a and b in each resample of units; draw 0 is the data as they are, r is null without variance.

    values (feature, unit, a, b) with each unit once a feature; units (unit, stratum, pos, n) as `bootstrap.stratified_units` numbers them,
    and resampled within strata. A task multiplies the draws' weights of a block of units with the features' values there and returns sums.
    """
    block = F.floor(F.col("pos") / UNITS).alias("block")
    placed = values.join(units.select("unit", "stratum", "pos"), "unit").where("a IS NOT NULL AND b IS NOT NULL")
    packed = placed.groupBy("feature", "stratum", block).agg(F.collect_list(F.struct("pos", "a", "b")).alias("v"))
    packed = packed.select(F.col("stratum").alias("s"), F.col("block").alias("b0"), "feature", F.col("v.pos").alias("pos"), F.col("v.a").alias("a"), F.col("v.b").alias("b"))
    weights = _block_weights(units, draws, seed, pick)
    kind = values.schema["feature"].dataType.simpleString()
    sums = packed.groupBy("s", "b0").cogroup(weights.groupBy("ws", "wb")).applyInPandas(
        _block_sums(draws), f"feature {kind}, draw int, w double, a double, b double, aa double, bb double, ab double"
    )
    t = sums.groupBy("feature", "draw").agg(*[F.sum(c).alias(c) for c in ("w", "a", "b", "aa", "bb", "ab")])
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("w"), F.col("bb") - F.col("b") * F.col("b") / F.col("w")
    # what is left of a constant's squares by rounding is no variance
    varied = (F.col("w") > 0) & (va > 1e-12 * F.col("aa")) & (vb > 1e-12 * F.col("bb"))
    return t.select("feature", "draw", F.when(varied, (F.col("ab") - F.col("a") * F.col("b") / F.col("w")) / F.sqrt(va * vb)).alias("r"))


def correlation_errors(values: DataFrame, units: DataFrame, attenuation: DataFrame, draws: int = 300, bins: int = 10, per_bin: int = 40, seed: int = 1, pick=hashed_pick) -> DataFrame:
    """(feature, bin, attn, rho_obs, se_obs, rho_true, se_true) on up to `per_bin` features of each quantile bin of the attenuation (feature, attn).

    Errors are deviations over draws in which the correlation is there; true ones are divided by the attenuation, null where it is 0.
    """
    shared = attenuation.join(values.select("feature").distinct(), "feature", "left_semi")
    chosen = stratified_sample(quantile_bins(shared, "attn", bins), "feature", "bin", per_bin, seed)
    r = draw_correlations(values.join(chosen.select("feature"), "feature", "left_semi"), units, draws, seed, pick)
    per = r.groupBy("feature").agg(F.max(F.when(F.col("draw") == 0, F.col("r"))).alias("rho_obs"), F.stddev_samp(F.when(F.col("draw") > 0, F.col("r"))).alias("se_obs"))
    a = F.when(F.col("attn") > 0, F.col("attn"))
    return chosen.join(per, "feature").select("feature", "bin", "attn", "rho_obs", "se_obs", (F.col("rho_obs") / a).alias("rho_true"), (F.col("se_obs") / a).alias("se_true"))
