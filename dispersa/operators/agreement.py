"""Agreement of noise estimates between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.functions.stats import spearman
from dispersa.operators.fitting import fit_dispersions
from dispersa.operators.qc import filter_depth, normalise_ids
from dispersa.sources.results import checkpointed


def implied_terms(df: DataFrame, scale: str = "count") -> DataFrame:
    """df (mean, cv2) with fano, bsize and disp; on a relative scale the shot noise can't be taken off and they are null."""
    if scale == "count":
        fano = F.col("mean") * F.col("cv2")
        return df.withColumn("fano", fano).withColumn("bsize", fano - 1).withColumn("disp", F.col("cv2") - F.try_divide(F.lit(1.0), F.col("mean")))
    none = F.lit(None).cast("double")
    return df.withColumn("fano", none).withColumn("bsize", none).withColumn("disp", none)


def relative_exposures(counts: DataFrame) -> DataFrame:
    """(dataset, unit, lib, expo): each unit's library over the mean library of its dataset."""
    lib = counts.groupBy("dataset", "unit").agg(F.sum("y").alias("lib"))
    mean = lib.groupBy("dataset").agg(F.avg("lib").alias("_m"))
    return lib.join(F.broadcast(mean), "dataset").select("dataset", "unit", "lib", (F.col("lib") / F.col("_m")).alias("expo"))  # a row a dataset


def source_counts(counts: DataFrame, aliases: DataFrame, pattern: str, least_unit: int, least_units: int) -> DataFrame:
    """(dataset, feature, unit, y) of published counts (source, id, unit, y): ids named, equal names summed, shallow units and rare features left out.

    Ids that match the pattern stand for themselves, others for their first alias (alias, feature, ord), those without one leave.
    """
    counts = checkpointed(counts)
    names = normalise_ids(counts.select("id").distinct(), aliases, pattern).where("feature IS NOT NULL")
    named = counts.join(names, "id").select(F.col("source").alias("dataset"), "feature", "unit", "y")
    # both filters read the named counts again, so these and what made them are computed once
    return filter_depth(checkpointed(named), least_unit, least_units)


def fit_sources(counts: DataFrame, aliases: DataFrame, pattern: str, least_unit: int, least_units: int) -> DataFrame:
    """(source, feature, mean, cv2, fano, disp, bsize) of all published count sources in one job, in the layout that sources share.

    Counts and exposures are read by each part of the fit, so they are written once.
    """
    kept = checkpointed(source_counts(counts, aliases, pattern, least_unit, least_units))
    fits = fit_dispersions(kept, checkpointed(relative_exposures(kept)))
    return fits.select(F.col("dataset").alias("source"), "feature", F.col("mu").alias("mean"), (F.col("cv") * F.col("cv")).alias("cv2"), "fano", "disp", "bsize")


def pairwise_agreement(df: DataFrame, value: str) -> DataFrame:
    """(source_a, source_b, n, rho): Spearman of a value for all unordered pairs of sources (source, feature, value).

    Pairs of sources are few; the features of each are joined by key.
    """
    a = df.select(F.col("source").alias("source_a"), "feature", F.col(value).alias("_a"))
    b = df.select(F.col("source").alias("source_b"), "feature", F.col(value).alias("_b"))
    both = a.join(b, "feature").where("source_a < source_b")
    return spearman(both, "_a", "_b", ["source_a", "source_b"])


def against_base(df: DataFrame, base: DataFrame, value: str) -> DataFrame:
    """(source, n, rho) of each source against a base table (feature, value)."""
    both = df.select("source", "feature", F.col(value).alias("_a")).join(base.select("feature", F.col(value).alias("_b")), "feature")
    return spearman(both, "_a", "_b", ["source"])


def mutual_best(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs in which each is the other's best by score, ties by name: by two grouped maxima, not by sorting groups."""
    best_b = pairs.groupBy(a).agg(F.max_by(F.col(b), F.struct(F.col(score), F.col(b))).alias(b))
    best_a = pairs.groupBy(b).agg(F.max_by(F.col(a), F.struct(F.col(score), F.col(a))).alias(a))
    return pairs.join(best_b, [a, b], "left_semi").join(best_a, [a, b], "left_semi")
