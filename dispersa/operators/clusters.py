"""Clusters of units across datasets, and what they and other covariates explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions.stats import benjamini_hochberg, kruskal_wallis, spearman
from dispersa.functions.tails import chi2_p, correlation_p
from dispersa.operators.coexpression import shrunken_correlations


def large_clusters(clusters: DataFrame, least: int) -> DataFrame:
    """(dataset, cluster, n) of clusters (dataset, unit, cluster) that hold at least `least` units of a dataset; units of a null cluster are in none."""
    return clusters.where("cluster IS NOT NULL").groupBy("dataset", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pseudo_bulk(counts: DataFrame, clusters: DataFrame, large: DataFrame) -> DataFrame:
    """(dataset, cluster, feature, y): counts summed over the units of each large cluster; features without counts have no row."""
    member = clusters.join(large.select("dataset", "cluster"), ["dataset", "cluster"])
    return counts.join(member, ["dataset", "unit"]).groupBy("dataset", "cluster", "feature").agg(F.sum("y").alias("y"))


def profile_correlations(a: DataFrame, b: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, cor): Pearson correlation of each profile of `a` with each of `b`, both (id, feature, y), over all of `features`.

    Missing rows are zeros: they enter through the number of features, so profiles meet only where both have counts. Null without variance.
    """
    total = features.select("feature").distinct().agg(F.count("*").cast("double").alias("_n"))
    x, z = F.col("y").cast("double"), F.col("_y").cast("double")
    sa = a.groupBy(F.col("id").alias("a")).agg(F.sum(x).alias("_sa"), F.sum(x * x).alias("_qa"))
    sb = b.groupBy(F.col("id").alias("b")).agg(F.sum(x).alias("_sb"), F.sum(x * x).alias("_qb"))
    both = a.select(F.col("id").alias("a"), "feature", "y").join(b.select(F.col("id").alias("b"), "feature", F.col("y").alias("_y")), "feature")
    cross = both.groupBy("a", "b").agg(F.sum(x * z).alias("_x"))
    # clusters are few: their pairs are a short table, also those that share no feature
    grid = sa.join(sb).join(cross, ["a", "b"], "left").join(total)
    n, va = F.col("_n"), F.col("_qa") - F.col("_sa") * F.col("_sa") / F.col("_n")
    vb = F.col("_qb") - F.col("_sb") * F.col("_sb") / n
    cov = F.coalesce("_x", F.lit(0.0)) - F.col("_sa") * F.col("_sb") / n
    return grid.select("a", "b", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("cor"))


def cluster_correlations(counts: DataFrame, clusters: DataFrame, pairs: list[tuple[str, str]], least: int) -> DataFrame:
    """(dataset_a, dataset_b, cluster_a, cluster_b, cor): pseudo-bulk correlations between the large clusters of pairs of datasets."""
    bulk = pseudo_bulk(counts, clusters, large_clusters(clusters, least))
    out = None
    for first, second in pairs:
        a, b = (bulk.where(F.col("dataset") == d).select(F.col("cluster").alias("id"), "feature", "y") for d in (first, second))
        part = profile_correlations(a, b, counts.where(F.col("dataset").isin(first, second)))
        part = part.select(F.lit(first).alias("dataset_a"), F.lit(second).alias("dataset_b"), F.col("a").alias("cluster_a"), F.col("b").alias("cluster_b"), "cor")
        out = part if out is None else out.union(part)
    return out


def comparison_cluster(counts: DataFrame, clusters: DataFrame, first: str, second: str, least: int) -> DataFrame:
    """(cluster_a, cluster_b, cor): the large cluster of one dataset that agrees best with the whole of another; nothing unless the other has exactly one large cluster."""
    large = large_clusters(clusters, least)
    a = pseudo_bulk(counts, clusters, large).where(F.col("dataset") == first).select(F.col("cluster").alias("id"), "feature", "y")
    only = large.where(F.col("dataset") == second).agg(F.count("*").alias("_k"), F.min("cluster").alias("cluster_b")).where("_k = 1").select("cluster_b")
    whole = counts.where(F.col("dataset") == second).groupBy("feature").agg(F.sum("y").alias("y")).select(F.lit("all").alias("id"), "feature", "y")
    found = profile_correlations(a, whole, counts.where(F.col("dataset").isin(first, second)))
    best = found.where("cor IS NOT NULL").orderBy(F.desc("cor"), "a").limit(1)
    return best.join(only).select(F.col("a").alias("cluster_a"), "cluster_b", "cor")


def cluster_crossing(clusters: DataFrame, first: str, second: str) -> DataFrame:
    """(a, b, n): units by their clusters in two views of the same units; units that lack one of them are left out."""
    a = clusters.where((F.col("dataset") == first) & F.col("cluster").isNotNull()).select("unit", F.col("cluster").alias("a"))
    b = clusters.where((F.col("dataset") == second) & F.col("cluster").isNotNull()).select("unit", F.col("cluster").alias("b"))
    return a.join(b, "unit").groupBy("a", "b").agg(F.count("*").alias("n"))


def consistent_pairs(crossing: DataFrame) -> DataFrame:
    """(a, b, n, share): pairs of clusters in which each is where most of the other's units are, ties to the least name; share of all units in the pair."""
    best_b = crossing.groupBy("a").agg(F.min_by("b", F.struct((-F.col("n")).alias("n"), "b")).alias("b"))
    best_a = crossing.groupBy("b").agg(F.min_by("a", F.struct((-F.col("n")).alias("n"), "a")).alias("a"))
    total = crossing.agg(F.sum("n").alias("_t"))
    kept = crossing.join(best_b, ["a", "b"], "left_semi").join(best_a, ["a", "b"], "left_semi")
    return kept.join(total).select("a", "b", "n", (F.col("n") / F.col("_t")).alias("share"))


def covariate_diagnostic(residuals: DataFrame, covariates: DataFrame) -> DataFrame:
    """(feature, n, rho, rho_p, rho_q, eta2, h, h_p, h_q): how residuals (unit, feature, r) follow a covariate x and a group of their units.

    covariates (unit, x, group). Spearman's rho with the t approximation; eta2 is the share of a feature's sum of squares between
    groups; Kruskal-Wallis with as many degrees of freedom as the feature has groups, less one. q-values are Benjamini-Hochberg over
    features. Units that lack x or a group are left out, tests without variance are null.
    """
    rows = residuals.join(covariates.where("x IS NOT NULL AND group IS NOT NULL").select("unit", "x", "group"), "unit").select("feature", "r", "x", "group")
    rank = spearman(rows, "r", "x", ["feature"])
    per = rows.groupBy("feature", "group").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = per.join(whole.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    square = whole.join(between, "feature").select("feature", "n", "k", F.try_divide("between", F.col("between") + F.col("within")).alias("eta2"))
    h = kruskal_wallis(rows, "r", "group", ["feature"])
    out = square.join(rank.select("feature", "rho"), "feature", "left").join(h, "feature", "left")
    tested = out.withColumn("rho_p", correlation_p(F.col("rho"), F.col("n"))).withColumn("h_p", chi2_p(F.col("h"), F.col("k") - 1))
    tested = benjamini_hochberg(benjamini_hochberg(tested, "rho_p", [], "rho_q"), "h_p", [], "h_q")
    return tested.select("feature", "n", "rho", "rho_p", "rho_q", "eta2", "h", "h_p", "h_q")


def diagnostic_summary(tests: DataFrame, sig: float = 0.05) -> DataFrame:
    """(test, n, significant, median_effect): tests of each kind, those with q under `sig`, and the median of |rho| or of eta2."""
    parts = [
        tests.agg(F.lit(name).alias("test"), F.count(q).alias("n"), F.count_if(F.col(q) < sig).alias("significant"), F.percentile(F.abs(F.col(effect)), 0.5).alias("median_effect"))
        for name, q, effect in (("covariate", "rho_q", "rho"), ("group", "h_q", "eta2"))
    ]
    return parts[0].union(parts[1])


def variance_ranking(counts: DataFrame, units: DataFrame) -> DataFrame:
    """(dataset, feature, mean, var, expected, standardised, rank): variances against a quadratic trend of log10 variance on log10 mean.

    Standardised values (y - mean) / sqrt(expected) are cut at the root of the number of units, and the standardised variance is
    the sum of their squares over n - 1; zeros enter by their number. Features without variance are left out. Ranks fall by the value to nine digits, ties by name.
    """
    n = units.groupBy("dataset").agg(F.count("*").alias("_n"))
    sums = counts.groupBy("dataset", "feature").agg(F.sum("y").alias("_s"), F.sum(F.col("y").cast("double") * F.col("y")).alias("_q"), F.count_if(F.col("y") != 0).alias("_nz"))
    size = F.col("_n").cast("double")
    mean = F.col("_s") / size
    var = (F.col("_q") - size * mean * mean) / (size - 1)
    moments = sums.join(F.broadcast(n), "dataset").select("dataset", "feature", "_n", "_nz", mean.alias("mean"), var.alias("var")).where("mean > 0 AND var > 0")  # a row a dataset
    x, y = F.log10("mean"), F.log10("var")
    logs = moments.select("dataset", x.alias("x"), (x * x).alias("z"), y.alias("y"))
    t = logs.groupBy("dataset").agg(*[F.avg(c).alias(f"m{c}") for c in "xzy"], *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "zz", "xz", "xy", "zy")])
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    bx, bz = F.try_divide(F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy"), det), F.try_divide(F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy"), det)
    line = t.select("dataset", bx.alias("_bx"), bz.alias("_bz"), (F.col("my") - bx * F.col("mx") - bz * F.col("mz")).alias("_b0"))
    fitted = moments.join(F.broadcast(line), "dataset").withColumn("expected", F.pow(F.lit(10.0), F.col("_b0") + F.col("_bx") * x + F.col("_bz") * x * x))
    away = (F.col("y") - F.col("mean")) / F.sqrt("expected")
    cut = F.least(away, F.sqrt("_n"))
    stored = counts.where("y <> 0").join(fitted, ["dataset", "feature"]).groupBy("dataset", "feature").agg(F.sum(cut * cut).alias("_z"))
    zeros = (F.col("_n") - F.col("_nz")) * F.col("mean") * F.col("mean") / F.col("expected")
    order = Window.partitionBy("dataset").orderBy(F.desc(F.round("standardised", 9)), "feature")  # a row for each feature
    out = fitted.join(stored, ["dataset", "feature"]).withColumn("standardised", (F.col("_z") + zeros) / (F.col("_n") - 1))
    return out.select("dataset", "feature", "mean", "var", "expected", "standardised", F.row_number().over(order).alias("rank"))


def variance_elbow(ranked: DataFrame, drop_fraction: float = 0.001, floor: float = 1.0) -> DataFrame:
    """(dataset, n_features): one past the last rank whose drop is over a fraction of the range, among features at or above the floor.

    Where fewer than two reach the floor all are searched; without such a drop all that are searched count.
    """
    enough = ranked.groupBy("dataset").agg((F.count_if(F.col("standardised") >= floor) >= 2).alias("_some"))
    searched = ranked.join(F.broadcast(enough), "dataset").where(~F.col("_some") | (F.col("standardised") >= floor))
    span = searched.groupBy("dataset").agg((F.max("standardised") - F.min("standardised")).alias("_range"), F.count("*").alias("_all"))
    drop = F.col("standardised") - F.lead("standardised").over(Window.partitionBy("dataset").orderBy("rank"))
    steps = searched.withColumn("_d", drop).join(F.broadcast(span), "dataset")
    last = F.max(F.when(F.col("_d") > drop_fraction * F.col("_range"), F.col("rank")))
    return steps.groupBy("dataset").agg(F.coalesce(last + 1, F.first("_all")).alias("n_features"))


def scaled_correlations(values: DataFrame, units: DataFrame) -> DataFrame:
    """(i, j, r) for i < j: plain correlations of values (unit, feature, x) over all units, missing values as zeros."""
    grid = units.select("unit").join(F.broadcast(values.select("feature").distinct()))  # features are the table's columns
    full = grid.join(values.select("unit", "feature", F.col("x").alias("r")), ["unit", "feature"], "left").na.fill(0.0, ["r"])
    return shrunken_correlations(full, shrink=False)


def component_elbow(axes: DataFrame, least: float = 0.05) -> DataFrame:
    """(components): one past the last component whose share of the summed deviations, in percent, falls by more than `least` to the next.

    axes (rank, eigenvalue); a deviation is the root of an eigenvalue. Null where no step is as large.
    """
    own = axes.select("rank", F.sqrt(F.greatest("eigenvalue", F.lit(0.0))).alias("_sd")).distinct()
    total = own.agg(F.sum("_sd").alias("_t"))
    pct = own.join(total).withColumn("_p", 100 * F.col("_sd") / F.col("_t"))
    step = pct.withColumn("_d", F.col("_p") - F.lead("_p").over(Window.orderBy("rank")))  # a row for each component
    return step.agg((F.max(F.when(F.col("_d") > least, F.col("rank"))) + 1).alias("components"))
