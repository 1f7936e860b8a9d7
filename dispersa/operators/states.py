"""Diagnostics of unit partitions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispersa.sources.results import checkpointed


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two partitions of the same rows, from the counts of their crossing."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    x = cells.agg(F.sum("c").alias("n"), F.sum(two("c")).alias("x"))
    ra = cells.groupBy("a").agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("ra"))
    rb = cells.groupBy("b").agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("rb"))
    out = x.join(F.broadcast(ra)).join(F.broadcast(rb))
    expected = F.try_divide(F.col("ra") * F.col("rb"), two("n"))
    return out.select("n", F.coalesce(F.try_divide(F.col("x") - expected, (F.col("ra") + F.col("rb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def within_between(counts: DataFrame, units: DataFrame, clusters: DataFrame, least: int = 2) -> DataFrame:
    """(dataset, feature, within, between): variance of mean-normalised rates within and between clusters, from sums over stored counts.

    Within is the weighted variance less shot noise, between the weighted variance of cluster means less the noise of those
    means; clusters under `least` units are left out. clusters: (dataset, unit, cluster).
    """
    member = clusters.join(units.select("dataset", "unit", "expo"), ["dataset", "unit"])
    sizes = member.groupBy("dataset", "cluster").agg(F.count("*").alias("nc")).where(F.col("nc") >= least)
    rate = F.col("y") / F.col("expo")
    rows = counts.join(member, ["dataset", "unit"])
    per = rows.groupBy("dataset", "feature", "cluster").agg(F.sum(rate).alias("s"), F.sum(rate * rate).alias("q"), F.sum(rate / F.col("expo")).alias("shot"))
    grid = counts.select("dataset", "feature").distinct().join(F.broadcast(sizes), "dataset").join(per, ["dataset", "feature", "cluster"], "left").na.fill(0.0, ["s", "q", "shot"])
    whole = grid.groupBy("dataset", "feature").agg(F.sum("nc").alias("n"), (F.sum("s") / F.sum("nc")).alias("m"))
    g = grid.join(whole, ["dataset", "feature"]).where("m > 0")
    nc, mean = F.col("nc"), F.col("s") / F.col("nc")
    var, shot = (F.col("q") - nc * mean * mean) / (nc - 1), F.col("shot") / nc
    noise = var / nc
    m2 = F.col("m") * F.col("m")
    return g.groupBy("dataset", "feature").agg(
        (F.sum(nc / F.col("n") * (var - shot) / m2)).alias("within"), F.sum(nc / F.col("n") * ((mean - F.col("m")) * (mean - F.col("m")) - noise) / m2).alias("between")
    )


def last_drop(ranked: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, elbow): one past the last rank whose drop to the next value is over `least`; null without any."""
    order = Window.partitionBy(*keys).orderBy("rank")
    drop = F.col(value) - F.lead(value).over(order)
    return ranked.withColumn("_d", drop).groupBy(*keys).agg((F.max(F.when(F.col("_d") > least, F.col("rank"))) + 1).alias("elbow"))


def plateaus(curve: DataFrame, keys: list[str], x: str, k: str) -> DataFrame:
    """curve with `run`: a number for each stretch of x over which k stays the same."""
    order = Window.partitionBy(*keys).orderBy(x)
    before = F.lag(k).over(order)
    return curve.withColumn("_new", F.when(before.isNotNull() & (before != F.col(k)), 1).otherwise(0)).withColumn("run", F.sum("_new").over(order)).drop("_new")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with `into` 1..n: each row's place in the order of some columns, nulls first; places of rows equal in all of them are arbitrary.

    Ranges of the order are sorted apart and written with the places inside them, so that a lost executor can't number its rows anew;
    a place is the rows of earlier ranges and the place inside. Equal values of the first columns may lie in several ranges, and no task holds more than a range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in a partition
    saved = checkpointed(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_inside", inside))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = saved.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    return saved.join(F.broadcast(base), "_range").withColumn(into, F.col("_base") + F.col("_inside") + 1).drop("_range", "_inside", "_base")


def equal_bins(df: DataFrame, value: str, bins: int, tiebreak: str) -> DataFrame:
    """df with `bin` 1..bins: ceil(rank / n * bins), ties in the tiebreak's order; rows without a value are left out."""
    placed = numbered(df.where(F.col(value).isNotNull()), [value, tiebreak], "_place")
    n = placed.agg(F.count("*").alias("_n"))
    return placed.join(F.broadcast(n)).withColumn("bin", F.ceil(F.col("_place") / F.col("_n") * bins)).drop("_place", "_n")


def cohens_d(df: DataFrame, x: str, first: Column) -> DataFrame:
    """(d): difference of two groups' means over their pooled standard deviation."""
    g = df.where(F.col(x).isNotNull()).agg(
        F.avg(F.when(first, F.col(x))).alias("m1"), F.avg(F.when(~first, F.col(x))).alias("m2"), F.var_samp(F.when(first, F.col(x))).alias("v1"), F.var_samp(F.when(~first, F.col(x))).alias("v2"),
        F.count(F.when(first, F.col(x))).alias("n1"), F.count(F.when(~first, F.col(x))).alias("n2"),
    )
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return g.select(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled)).alias("d"))


def module_scores(values: DataFrame, members: DataFrame, bins: int = 24, controls: int = 100, seed: int = 1) -> DataFrame:
    """(unit, score): mean of a feature set less the mean of control features of the same mean-expression bins.

    values (unit, feature, x) hold every feature of a unit. Each member draws `controls` features of its bin in a hashed order.
    """
    means = values.groupBy("feature").agg(F.avg("x").alias("m"))
    binned = means.withColumn("bin", F.ntile(bins).over(Window.orderBy("m", "feature")))  # a row for each feature
    own = members.select("feature").distinct().join(binned, "feature")
    pool = own.select(F.col("feature").alias("member"), "bin").join(binned.select("feature", "bin"), "bin").join(own.select("feature"), "feature", "left_anti")
    order = Window.partitionBy("member").orderBy(F.xxhash64(F.lit(seed), "member", "feature"))
    chosen = pool.withColumn("k", F.row_number().over(order)).where(F.col("k") <= controls).select("feature").distinct()
    marks = own.select("feature", F.lit(True).alias("own")).union(chosen.select("feature", F.lit(False)))
    per = values.join(F.broadcast(marks), "feature").groupBy("unit").agg(F.avg(F.when(F.col("own"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("own"), F.col("x"))).alias("b"))
    return per.select("unit", (F.col("a") - F.coalesce("b", F.lit(0.0))).alias("score"))


def normalised(counts: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """(dataset, unit, feature, x): log1p of counts per `scale` of the unit's library."""
    lib = counts.groupBy("dataset", "unit").agg(F.sum("y").alias("_l"))
    return counts.join(lib, ["dataset", "unit"]).select("dataset", "unit", "feature", F.log1p(F.col("y") / F.col("_l") * scale).alias("x"))


def principal_axis(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with `axis`: first component of two scaled columns, which is their sum or difference over root two by the sign of their correlation."""
    s = df.agg(F.avg(a).alias("_ma"), F.stddev_samp(a).alias("_sa"), F.avg(b).alias("_mb"), F.stddev_samp(b).alias("_sb"), F.corr(a, b).alias("_r"))
    za, zb = (F.col(a) - F.col("_ma")) / F.col("_sa"), (F.col(b) - F.col("_mb")) / F.col("_sb")
    return df.join(F.broadcast(s)).withColumn("axis", (za + F.signum("_r") * zb) / F.sqrt(F.lit(2.0))).drop("_ma", "_sa", "_mb", "_sb", "_r")


def best_partition(df: DataFrame, vector: str, ks: list[int], least: int, tolerance: float = 0.0, seed: int = 1) -> tuple[DataFrame, int]:
    """(df with `cluster`, k): KMeans over several k by silhouette; the least k within `tolerance` of the best whose clusters all have `least` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(df)
        out = model.transform(df)
        if out.groupBy("cluster").count().agg(F.min("count")).first()[0] >= least:
            found.append((ClusteringEvaluator(featuresCol=vector, predictionCol="cluster").evaluate(out), k, out))
    if not found:
        raise ValueError("no setting has clusters of the least size")
    top = max(s for s, _, _ in found)
    _, k, out = min((x for x in found if x[0] >= top - tolerance), key=lambda x: x[1])
    return out, k


def composition(df: DataFrame, group: str, cluster: str) -> DataFrame:
    """(group, cluster, n, share): rows of each cluster within a group."""
    n = df.groupBy(group, cluster).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def marker_tests(values: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, feature, lfc, z): each cluster against the rest, by rank sums over stored values with all zeros as one tied block.

    values (unit, feature, x > 0) leave zeros out; clusters (unit, cluster). lfc: log2 of mean expm1 + 1 between the two sides.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n1"))
    total = clusters.agg(F.count("*").alias("n"))
    rows = values.join(clusters, "unit")
    per = rows.groupBy("feature", "x").agg(F.count("*").alias("c"))
    below = Window.partitionBy("feature").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    per = per.withColumn("_nz", F.sum("c").over(whole)).withColumn("_b", F.coalesce(F.sum("c").over(below), F.lit(0))).join(F.broadcast(total))
    zeros = F.col("n") - F.col("_nz")
    per = per.withColumn("r", zeros + F.col("_b") + (F.col("c") + 1) / 2).withColumn("t", F.pow("c", F.lit(3)) - F.col("c"))
    ties = per.groupBy("feature").agg((F.sum("t") + F.first(F.pow(zeros, F.lit(3)) - zeros)).alias("ties"), F.first(zeros).alias("zeros"))
    own = rows.join(per.select("feature", "x", "r"), ["feature", "x"]).groupBy("feature", "cluster").agg(F.sum("r").alias("w"), F.count("*").alias("nz1"), F.sum(F.expm1("x")).alias("s1"))
    all_s = rows.groupBy("feature").agg(F.sum(F.expm1("x")).alias("s"))
    grid = all_s.join(F.broadcast(sizes)).join(own, ["feature", "cluster"], "left").na.fill(0, ["w", "nz1", "s1"]).join(ties, "feature").join(F.broadcast(total))
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    w = F.col("w") + (n1 - F.col("nz1")) * (F.col("zeros") + 1) / 2
    away = w - n1 * (n1 + 1) / 2 - n1 * n2 / 2
    n = F.col("n").cast("double")
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    lfc = F.log2(F.col("s1") / n1 + 1) - F.log2((F.col("s") - F.col("s1")) / n2 + 1)
    return grid.select("cluster", "feature", lfc.alias("lfc"), F.try_divide(away - F.signum(away) * 0.5, sd).alias("z"))
