"""Exposures, allele shares and depth-matched splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARENTS = ("MIX.SC", "MIX.SE")  # fixed values: names of the parents and alleles in tables of this layout
ALLELES = ("HYB.SC", "HYB.SE")


def exposures(units: DataFrame, parents: tuple[str, ...] = PARENTS) -> DataFrame:
    """units (dataset, unit, lib) with `expo`: lib over the parents' median lib; both alleles of a unit get half of their sum."""
    depth = units.where(F.col("dataset").isin(*parents)).agg(F.percentile("lib", 0.5).alias("_d"))
    both = units.where(~F.col("dataset").isin(*parents)).groupBy("unit").agg(F.sum("lib").alias("_s"))
    own = units.join(both, "unit", "left").join(F.broadcast(depth))
    lib = F.when(F.col("dataset").isin(*parents), F.col("lib")).otherwise(F.col("_s") / 2)
    return own.withColumn("expo", lib / F.col("_d")).drop("_s", "_d")


def allele_pairs(units: DataFrame, alleles: tuple[str, str] = ALLELES) -> DataFrame:
    """(unit, a, b): the alleles' libraries side by side, 0 where a unit has none of one."""
    a = units.where(F.col("dataset") == alleles[0]).select("unit", F.col("lib").alias("a"))
    b = units.where(F.col("dataset") == alleles[1]).select("unit", F.col("lib").alias("b"))
    return a.join(b, "unit", "full").na.fill(0, ["a", "b"])


def share_terms(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: mean share of the first allele, its observed, binomial and true variance, corrections and log2 offset."""
    c = F.col("a") / (F.col("a") + F.col("b"))
    one = pairs.where(F.col("a") + F.col("b") > 1).select(c.alias("c"), (c * (1 - c) / (F.col("a") + F.col("b") - 1)).alias("b"))
    t = one.agg(F.avg("c").alias("cbar"), F.var_samp("c").alias("var_obs"), F.avg("b").alias("var_binom"))
    t = t.withColumn("var_c", F.greatest(F.col("var_obs") - F.col("var_binom"), F.lit(0.0)))
    return t.select(
        "cbar", "var_obs", "var_binom", "var_c", (F.col("var_obs") < F.col("var_binom")).alias("negative"),
        (F.col("var_c") / (F.col("cbar") * F.col("cbar"))).alias("r_c"), (F.col("var_c") / ((1 - F.col("cbar")) * (1 - F.col("cbar")))).alias("r_e"),
        F.log2(F.col("cbar") / (1 - F.col("cbar"))).alias("offset"),
    )


def allele_side(dataset: str) -> Column:
    """SC or SE for an allele's dataset, null for others."""
    return F.nullif(F.regexp_extract(dataset, r"^HY[BCT]\.(SC|SE)", 1), F.lit(""))


def share_correction(datasets: DataFrame, terms: DataFrame) -> DataFrame:
    """(dataset, share_r) of each dataset's name."""
    side = allele_side("dataset")
    return datasets.select("dataset").join(F.broadcast(terms)).select("dataset", F.when(side == "SC", F.col("r_c")).when(side == "SE", F.col("r_e")).otherwise(0.0).alias("share_r"))


def depth_order(units: DataFrame) -> DataFrame:
    """units with `rank_depth` from 1, the deepest first, ties by unit, within the dataset.

    Depths are counted first and ranked among each other, so that a rank within a depth is all that is left for
    units of the same depth.
    """
    depths = units.groupBy("dataset", "lib").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("dataset").orderBy(F.desc("lib")).rowsBetween(Window.unboundedPreceding, -1)
    depths = depths.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    inside = Window.partitionBy("dataset", "lib").orderBy("unit")
    return units.join(depths, ["dataset", "lib"]).withColumn("rank_depth", F.col("_above") + F.row_number().over(inside)).drop("_above")


def depth_split(ranked: DataFrame, fraction: float) -> DataFrame:
    """ranked units with `side`: c at round(f n) depth ranks that are evenly spread, t at all others."""
    size = ranked.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("k", F.bround(F.lit(fraction) * F.col("n"), 0).cast("long"))
    step = F.when(F.col("k") > 1, (F.col("n") - 1) / (F.col("k") - 1)).otherwise(0.0)
    chosen = size.where("k > 0").select("dataset", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.bround(1 + j * step, 0).cast("long"))).alias("rank_depth")).distinct()
    return ranked.join(chosen.withColumn("_c", F.lit(True)), ["dataset", "rank_depth"], "left").withColumn("side", F.when(F.col("_c"), "c").otherwise("t")).drop("_c")


def split_fraction(r: Column) -> Column:
    """Best split for a variance ratio r: ((2 + r) - sqrt(r^2 + 4)) / (2 r), one half for r near 0."""
    return F.when(F.abs(r) < 1e-8, 0.5).otherwise(((2 + r) - F.sqrt(r * r + 4)) / (2 * r))
