"""Quality control of units and features of a sparse count table (dataset, feature, unit, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826  # fixed value: MAD to standard deviation of a normal


def unit_totals(counts: DataFrame) -> DataFrame:
    """(dataset, unit, lib, det): library size and number of detected features."""
    return counts.groupBy("dataset", "unit").agg(F.sum("y").alias("lib"), F.count("*").alias("det"))


def merge_features(counts: DataFrame, source: str, into: str, drop: Sequence[str] = ()) -> DataFrame:
    """Add one feature's counts to another's, then leave some features out."""
    named = counts.withColumn("feature", F.when(F.col("feature") == source, into).otherwise(F.col("feature")))
    return named.where(~F.col("feature").isin(list(drop))).groupBy("dataset", "feature", "unit").agg(F.sum("y").alias("y"))


def minority_fraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """(unit, a, b, fraction) of units in both totals tables (unit, lib): the smaller share of their reads."""
    both = a.select("unit", F.col("lib").alias("a")).join(b.select("unit", F.col("lib").alias("b")), "unit")
    return both.withColumn("fraction", F.least("a", "b") / (F.col("a") + F.col("b")))


def route_units(fractions: DataFrame, most: float) -> DataFrame:
    """(unit, drop_a, drop_b): over `most` a unit leaves both datasets, else only the one with fewer of its reads."""
    high = F.col("fraction") > most
    return fractions.select("unit", (high | (F.col("a") < F.col("b"))).alias("drop_a"), (high | (F.col("b") <= F.col("a"))).alias("drop_b"))


def exceedance(values: DataFrame, column: str, thresholds: DataFrame) -> DataFrame:
    """(threshold, n): values over each threshold of a short table; values are counted between thresholds first."""
    cut = F.broadcast(thresholds.select("threshold"))
    return values.where(F.col(column).isNotNull()).select(column).join(cut, F.col(column) > F.col("threshold"), "right").groupBy("threshold").agg(F.count(column).alias("n"))


def robust_centre(values: DataFrame, group: str, column: str) -> DataFrame:
    """(group, med, mad): median and scaled median absolute deviation, exact, in two grouped aggregates."""
    med = values.groupBy(group).agg(F.percentile(column, 0.5).alias("med"))
    return (
        values.join(F.broadcast(med), group)
        .groupBy(group)
        .agg(F.first("med").alias("med"), (F.percentile(F.abs(F.col(column) - F.col("med")), 0.5) * MAD_SCALE).alias("mad"))
    )


def lower_tail_keep(units: DataFrame, k: float = 3.0, least: float = 500.0) -> DataFrame:
    """units with `keep`: lib at least max(least, 10^(median - k MAD)) of log10 lib, for each dataset."""
    logged = units.withColumn("_l", F.log10("lib"))
    centre = robust_centre(logged, "dataset", "_l")
    cut = F.greatest(F.lit(float(least)), F.pow(F.lit(10.0), F.col("med") - k * F.col("mad")))
    return units.join(F.broadcast(centre), "dataset").withColumn("keep", F.col("lib") >= cut).drop("med", "mad")


def upper_outliers(units: DataFrame, k: float = 4.0) -> DataFrame:
    """units with `lib_hi` and `det_hi`: over median + k MAD of the log10 within the dataset."""
    for column, flag in (("lib", "lib_hi"), ("det", "det_hi")):
        centre = robust_centre(units.withColumn("_l", F.log10(column)), "dataset", "_l")
        units = units.join(F.broadcast(centre), "dataset").withColumn(flag, F.log10(column) > F.col("med") + k * F.col("mad")).drop("med", "mad")
    return units


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def dying_units(units: DataFrame, k: float = 5.0) -> DataFrame:
    """units (dataset, unit, lib, special) with `flag`: logit of the special share over median + k MAD and lib below the median, where MAD > 0."""
    share = F.greatest(F.least(F.col("special") / F.col("lib"), F.lit(1 - 1e-4)), F.lit(1e-4))
    logged = units.withColumn("_l", logit(share))
    centre = robust_centre(logged, "dataset", "_l")
    lib = units.groupBy("dataset").agg(F.percentile("lib", 0.5).alias("_lib"))
    out = logged.join(F.broadcast(centre), "dataset").join(F.broadcast(lib), "dataset")
    flag = (F.col("_l") > F.col("med") + k * F.col("mad")) & (F.col("lib") < F.col("_lib")) & (F.col("mad") > 0)
    return out.withColumn("flag", flag).drop("_l", "med", "mad", "_lib")


def share_z(alleles: DataFrame, p0: float, spread: float) -> DataFrame:
    """(unit, a, b, z): robust z of the logit allele share with binomial and extra spread; infinite with one allele only."""
    one = (F.col("a") == 0) | (F.col("b") == 0)
    logged = alleles.withColumn("_l", F.when(~one, F.ln(F.col("a") / F.col("b"))))
    centre = logged.agg(F.percentile("_l", 0.5).alias("_m"))
    scale = F.sqrt(1 / ((F.col("a") + F.col("b")) * p0 * (1 - p0)) + spread * spread)
    z = F.when(one, F.lit(float("inf"))).otherwise(F.abs(F.col("_l") - F.col("_m")) / scale)
    return logged.join(F.broadcast(centre)).withColumn("z", z).drop("_l", "_m")


def multiplet_rate(both: int, n: int, p: float, low: float = 0.01, high: float = 0.4) -> float:
    """Share of multiplets of which cross pairs are 2 p (1 - p), clipped."""
    return min(high, max(low, both / n / (2 * p * (1 - p))))


def multiplet_calls(units: DataFrame, score: str = "score") -> DataFrame:
    """units (lib_hi, det_hi, score) with `multiplet`."""
    called = (F.col("lib_hi") & F.col("det_hi")) | ((F.col(score) >= 0.5) & (F.col("lib_hi") | F.col("det_hi")))
    return units.withColumn("multiplet", called)


def dataset_depths(counts: DataFrame) -> DataFrame:
    """(dataset, n_units, reads, per_unit): counted in two steps, so that no dataset's units are held together."""
    by_unit = counts.groupBy("dataset", "unit").agg(F.sum("y").alias("lib"))
    return by_unit.groupBy("dataset").agg(F.count("*").alias("n_units"), F.sum("lib").alias("reads"), F.avg("lib").alias("per_unit"))


def feature_pass(counts: DataFrame, floor: float, unit_share: float) -> DataFrame:
    """(feature, dataset, ok) on the whole grid: share of the reads at least floor / least depth, detected in enough units."""
    depths = dataset_depths(counts)
    limits = depths.agg((floor / F.min("per_unit")).alias("_p"), F.ceil(unit_share * F.min("n_units")).alias("_c"))
    per = counts.groupBy("dataset", "feature").agg(F.sum("y").alias("_y"), F.count("*").alias("_n"))
    grid = counts.select("feature").distinct().join(F.broadcast(depths.select("dataset", "reads")))
    full = grid.join(per, ["dataset", "feature"], "left").na.fill(0, ["_y", "_n"]).join(F.broadcast(limits))
    return full.select("feature", "dataset", ((F.col("_y") / F.col("reads") >= F.col("_p")) & (F.col("_n") >= F.col("_c"))).alias("ok"))


def keep_features(passes: DataFrame, rule: str = "any") -> DataFrame:
    """Features that pass in any or in all datasets."""
    held = {"any": F.bool_or, "all": F.bool_and}[rule]
    return passes.groupBy("feature").agg(held("ok").alias("ok")).where("ok").select("feature")


def pass_patterns(passes: DataFrame) -> DataFrame:
    """(pattern, n): features by their datasets' passes, as 0 and 1 in the order of the datasets' names."""
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dataset", F.col("ok").cast("int").alias("ok")))), lambda s: s["ok"].cast("string")), "")
    return passes.groupBy("feature").agg(digits.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def normalise_ids(ids: DataFrame, aliases: DataFrame, pattern: str) -> DataFrame:
    """(id, feature): ids that match the pattern stand for themselves, others by their first alias with '.' as '-', else null."""
    first = aliases.groupBy("alias").agg(F.min_by("feature", "ord").alias("_f"))
    named = F.when(F.col("id").rlike(pattern), F.col("id")).otherwise(F.regexp_replace("_f", r"\.", "-"))
    return ids.join(first, F.col("id") == F.col("alias"), "left").select("id", named.alias("feature"))


def filter_depth(counts: DataFrame, least_unit: int, least_units: int) -> DataFrame:
    """Counts summed by feature, without units under `least_unit` reads, then without features in fewer than `least_units` units."""
    summed = counts.where("feature IS NOT NULL").groupBy("dataset", "feature", "unit").agg(F.sum("y").alias("y"))
    units = summed.groupBy("dataset", "unit").agg(F.sum("y").alias("_l")).where(F.col("_l") >= least_unit)
    kept = summed.join(units.select("dataset", "unit"), ["dataset", "unit"], "left_semi")
    features = kept.groupBy("dataset", "feature").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_units)
    return kept.join(features.select("dataset", "feature"), ["dataset", "feature"], "left_semi")


def density_valley(values: DataFrame, column: str, adjust: float = 1.5, grid: int = 512, least: int = 50) -> DataFrame:
    """(valley): the lowest point of a kernel density between its two highest modes; null under `least` values or two modes.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5) times adjust. Values are counted in fine bins before they meet
    the grid, so the work of the density doesn't follow the rows.
    """
    x = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    s = x.agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"), F.percentile("x", 0.25).alias("q1"), F.percentile("x", 0.75).alias("q3"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = 0.9 * adjust * F.least("sd", (F.col("q3") - F.col("q1")) / 1.34) * F.pow("n", F.lit(-0.2))
    s = s.withColumn("bw", width).withColumn("a", F.col("lo") - 3 * F.col("bw")).withColumn("w", (F.col("hi") - F.col("lo") + 6 * F.col("bw")) / (grid - 1))
    bins = x.join(F.broadcast(s)).where((F.col("n") >= least) & (F.col("bw") > 0)).groupBy(F.round((F.col("x") - F.col("a")) / F.col("w") * 8).cast("long").alias("b")).agg(F.count("*").alias("c"), F.first("a").alias("a"), F.first("w").alias("w"), F.first("bw").alias("bw"))
    points = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    z = (F.col("g") - F.col("b") / 8) * F.col("w") / F.col("bw")
    curve = points.groupBy("g").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("d"), F.first(F.col("a") + F.col("g") * F.col("w")).alias("at"))
    order = Window.orderBy("g")  # `grid` rows
    modes = curve.withColumn("m", (F.col("d") > F.lag("d").over(order)) & (F.col("d") >= F.lead("d").over(order)))
    top = modes.where("m").orderBy(F.desc("d")).limit(2).agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("k"))
    between = curve.join(F.broadcast(top)).where("k = 2 AND g >= g0 AND g <= g1")
    return between.agg(F.min_by("at", "d").alias("valley"))
