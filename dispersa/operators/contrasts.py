"""Weighted contrasts between the fits of several datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.functions.stats import defined, log2_or_negative_infinity
from dispersa.operators.offsets import allele_side

# The modes' datasets and weights. Sources of the noise axis are the splits marked N, of the kinetic axis those marked K.
MODE_GROUPS = {
    "total": {"MIX.SC": 1.0, "MIX.SE": -1.0},
    "cis": {"HYC.SC": 1.0, "HYC.SE": -1.0},
    "trans": {"MIX.SC": 1.0, "MIX.SE": -1.0, "HYT.SC": -1.0, "HYT.SE": 1.0},
    "cis_n": {"HYC.SC.N": 1.0, "HYC.SE.N": -1.0},
    "trans_n": {"MIX.SC": 1.0, "MIX.SE": -1.0, "HYT.SC.N": -1.0, "HYT.SE.N": 1.0},
    "cis_k": {"HYC.SC.K": 1.0, "HYC.SE.K": -1.0},
    "trans_k": {"MIX.SC": 1.0, "MIX.SE": -1.0, "HYT.SC.K": -1.0, "HYT.SE.K": 1.0},
    "mid": {"HYB.SC": 0.5, "HYB.SE": 0.5, "MIX.SC": -0.5, "MIX.SE": -0.5},
    "par_sc": {"HYB.SC": 0.5, "HYB.SE": 0.5, "MIX.SC": -1.0},
    "par_se": {"HYB.SC": 0.5, "HYB.SE": 0.5, "MIX.SE": -1.0},
}
ARITHMETIC = ("mid", "par_sc", "par_se")


def mode_groups(spark: SparkSession, modes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(mode, dataset, weight, k): the dimension table of contrasts, k the number of datasets of the mode."""
    rows = [(m, d, w, len(g)) for m, g in (modes or MODE_GROUPS).items() for d, w in g.items()]
    return spark.createDataFrame(rows, "mode string, dataset string, weight double, k int")


def per_genome_means(fits: DataFrame, cbar: float | Column) -> DataFrame:
    """fits with an allele's mean over its abundance factor, twice its mean share."""
    side, cbar = allele_side("dataset"), cbar if isinstance(cbar, Column) else F.lit(cbar)
    return fits.withColumn("mu", F.when(side == "SC", F.col("mu") / (2 * cbar)).when(side == "SE", F.col("mu") / (2 * (1 - cbar))).otherwise(F.col("mu")))


def contrasts(fits: DataFrame, groups: DataFrame, zero_inf: bool = False) -> DataFrame:
    """(feature, mode, mean, disp, raw, cv2): all contrasts by one join with the dimension and one grouped sum.

    mean: log2 of the mean rates, of arithmetic means of both sides for modes of a hybrid against parents. disp: log2 of the
    dispersions, which must all be positive, or with `zero_inf` not negative, zero as -Infinity. raw: their
    difference. cv2: log2 of phi + 1 / mu. Null where a dataset or a valid value of the mode is missing.
    """
    w, mu, phi = F.col("weight"), F.col("mu"), F.col("disp")
    cv2 = F.when((mu > 0) & (phi >= 0), phi + 1 / mu)
    rows = fits.select("dataset", "feature", "mu", "disp").join(F.broadcast(groups), "dataset")
    log = log2_or_negative_infinity if zero_inf else (lambda x: F.when(x > 0, F.log2(x)))
    up, down = F.when(w > 0, w * mu), F.when(w < 0, -w * mu)
    per = rows.groupBy("feature", "mode").agg(
        F.first("k").alias("k"), F.count(mu).alias("nm"), F.sum(w * log(mu)).alias("gm"), F.count(log(mu)).alias("ngm"), F.sum(up).alias("up"), F.sum(down).alias("down"),
        F.sum(w * log(phi)).alias("d"), F.count(log(phi)).alias("nd"), F.sum(F.when(phi >= 0, w * phi)).alias("r"), F.count_if(phi >= 0).alias("nr"),
        F.sum(w * log(cv2)).alias("c"), F.count(log(cv2)).alias("nc"),
    )
    k = F.col("k")
    arithmetic = F.when(F.col("nm") == k, log(F.col("up")) - log(F.col("down")))
    mean = F.when(F.col("mode").isin(*ARITHMETIC), arithmetic).otherwise(F.when(F.col("ngm") == k, F.col("gm")))
    return per.select(
        "feature", "mode", defined(mean).alias("mean"), defined(F.when(F.col("nd") == k, F.col("d"))).alias("disp"),
        F.when(F.col("nr") == k, F.col("r")).alias("raw"), defined(F.when(F.col("nc") == k, F.col("c"))).alias("cv2"),
    )


def derived(contrast: DataFrame) -> DataFrame:
    """contrasts with bsize = mean + disp and kbal = -mean - 2 disp; undefined sums of infinities are null."""
    return contrast.withColumn("bsize", defined(F.col("mean") + F.col("disp"))).withColumn("kbal", defined(-F.col("mean") - 2 * F.col("disp")))


def gate(rows: DataFrame, gates: DataFrame, needs: DataFrame, value: str) -> DataFrame:
    """rows (feature, mode, quantity, value) with null where one of the quantity's scales isn't open for the feature and mode.

    gates: (feature, mode, scale, ok); needs: (quantity, scale), a small dimension.
    """
    held = gates.join(F.broadcast(needs), "scale").groupBy("feature", "mode", "quantity").agg(F.bool_and("ok").alias("_ok"), F.count("*").alias("_n"))
    wanted = needs.groupBy("quantity").agg(F.count("*").alias("_k"))
    out = rows.join(F.broadcast(wanted), "quantity", "left").join(held, ["feature", "mode", "quantity"], "left")
    is_open = F.col("_k").isNull() | (F.col("_ok") & (F.col("_n") == F.col("_k")))
    return out.withColumn(value, F.when(is_open, F.col(value))).drop("_ok", "_n", "_k")
