"""Summaries of fits, contrasts and splits, and the set operations that they are made with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions import stats, tails
from dispersa.operators.offsets import split_fraction


def flag_sizes(df: DataFrame, flags: list[str], groups: list[str]) -> DataFrame:
    """(groups, flag, n): how many rows each boolean column marks; null counts as not marked."""
    return df.unpivot(groups, flags, "flag", "set").groupBy(*groups, "flag").agg(F.count_if("set").alias("n"))


def intrinsic_extrinsic(components: DataFrame) -> DataFrame:
    """(feature, intr, extr): an allele's own noise and the noise that both share."""
    return components.select("feature", F.col("sigma_q").alias("intr"), F.col("sigma_d").alias("extr"))


def ploidy_shift(components: DataFrame, scale: str = "log2") -> DataFrame:
    """(feature, shift): the expected fall of a sum of alleles' dispersion, in log2 or in the dispersion itself ("raw")."""
    return components.select("feature", F.col({"log2": "delta", "raw": "delta_raw"}[scale]).alias("shift"))


def ploidy_factor(fits: DataFrame, shifts: DataFrame) -> DataFrame:
    """(dataset, feature, f2): g (1 + phi mu) / (g + phi mu) with g = 2^-shift; 1 where that isn't finite or a shift is missing."""
    g, x = F.pow(F.lit(2.0), -F.col("shift")), F.col("disp") * F.col("mu")
    f2 = F.try_divide(g * (1 + x), g + x)
    finite = f2.isNotNull() & ~F.isnan(f2) & (F.abs(f2) < float("inf"))
    return fits.join(shifts, "feature", "left").select("dataset", "feature", F.when(finite, f2).otherwise(1.0).alias("f2"))


def asymptotic_mean_se(fits: DataFrame, units: DataFrame) -> DataFrame:
    """(dataset, feature, se): standard error of log mu by the expected information, the sum of m / (1 + phi m) over all units.

    Units of one exposure count once, so a fit meets a dataset's distinct exposures and not its units.
    """
    spectrum = units.groupBy("dataset", "expo").agg(F.count("*").alias("n"))
    m = F.col("mu") * F.col("expo")
    info = F.sum(F.col("n") * m / (1 + F.greatest("disp", F.lit(0.0)) * m))
    return fits.where("mu > 0").join(spectrum, "dataset").groupBy("dataset", "feature").agg((1 / F.sqrt(info)).alias("se"))


def weighted_median(df: DataFrame, value: str, weight: str, groups: list[str]) -> DataFrame:
    """(groups, median): the least value at which the weights up to it reach half of all; rows of a value are added up first."""
    per = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    up = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_c", F.sum("_w").over(up)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*groups)))
    return per.where("2 * _c >= _t").groupBy(*groups).agg(F.min(value).alias("median"))


def ratio_axes(fits: DataFrame, first: str, second: str, zero_inf: bool = False) -> DataFrame:
    """(feature, mu, disp, cv2, rdisp): log2 ratios of two datasets' fits and the difference of their dispersions.

    A ratio needs two positive values; with `zero_inf` a dispersion of zero is -Infinity, and null where both are zero.
    """
    a = fits.where(F.col("dataset") == first).select("feature", F.col("mu").alias("ma"), F.col("disp").alias("da"))
    b = fits.where(F.col("dataset") == second).select("feature", F.col("mu").alias("mb"), F.col("disp").alias("db"))
    cv2 = lambda m, d: F.when((F.col(m) > 0) & (F.col(d) >= 0), F.col(d) + 1 / F.col(m))
    log = lambda x, y: F.when((x > 0) & (y > 0), F.log2(x) - F.log2(y))
    da, db = F.col("da"), F.col("db")
    disp = log(da, db)
    if zero_inf:
        disp = stats.defined(F.when((da >= 0) & (db >= 0), stats.log2_or_negative_infinity(da) - stats.log2_or_negative_infinity(db)))
    both = a.join(b, "feature")
    return both.select("feature", log(F.col("ma"), F.col("mb")).alias("mu"), disp.alias("disp"), log(cv2("ma", "da"), cv2("mb", "db")).alias("cv2"), F.when((da >= 0) & (db >= 0), da - db).alias("rdisp"))


def burst_contrasts(fits: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature, mode, bsize, kbal): weighted sums of burst size mu phi and kinetic balance 1 / (mu phi^2) over a mode's datasets.

    A burst size takes the mean of the matching mean split, the dataset without the mark N; a kinetic balance takes both from
    one dataset. Null where a dataset of the mode is missing or its quantity isn't defined.
    """
    mean = fits.select(F.col("dataset").alias("_m"), F.col("feature").alias("_f"), F.col("mu").alias("mean"))
    rows = fits.select("dataset", "feature", "mu", "disp").join(F.broadcast(groups), "dataset")
    rows = rows.join(mean, (F.col("feature") == F.col("_f")) & (F.regexp_replace("dataset", r"\.N$", "") == F.col("_m")), "left")
    mu, phi, w = F.col("mu"), F.col("disp"), F.col("weight")
    size = F.when((F.col("mean") >= 0) & (phi >= 0), F.col("mean") * phi)
    balance = F.when((mu > 0) & (phi > 0), 1 / (mu * phi * phi))
    per = rows.groupBy("feature", "mode").agg(F.first("k").alias("k"), F.sum(w * size).alias("s"), F.count(size).alias("ns"), F.sum(w * balance).alias("b"), F.count(balance).alias("nb"))
    return per.select("feature", "mode", F.when(F.col("ns") == F.col("k"), F.col("s")).alias("bsize"), F.when(F.col("nb") == F.col("k"), F.col("b")).alias("kbal"))


def share_term(terms: DataFrame, fits: DataFrame) -> DataFrame:
    """(dataset, share_r, median_disp, relative): the share's part of an allele's dispersion beside the median positive one."""
    median = fits.where("disp > 0").groupBy("dataset").agg(F.percentile("disp", 0.5).alias("median_disp"))
    return terms.join(median, "dataset").withColumn("relative", F.try_divide("share_r", "median_disp"))


def delta_pilot(counts: DataFrame, sizes: DataFrame, alleles: tuple[str, str] = ("HYB.SC", "HYB.SE")) -> DataFrame:
    """(feature, dataset, se): delta-method standard errors of log means, and rows of dataset "cov" with the alleles' covariance.

    sizes: (dataset, n), the units of each dataset, zeros included.
    """
    s = counts.groupBy("dataset", "feature").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).join(F.broadcast(sizes), "dataset")
    mean = F.col("s") / F.col("n")
    se = s.select("feature", "dataset", F.sqrt((F.col("q") / F.col("n") - mean * mean) / F.col("n")) / mean).toDF("feature", "dataset", "se")
    pair = counts.where(F.col("dataset").isin(*alleles)).groupBy("feature", "unit")
    a, b = (F.sum(F.when(F.col("dataset") == x, F.col("y")).otherwise(0)) for x in alleles)
    n = sizes.where(F.col("dataset") == alleles[0]).select(F.col("n").alias("m"))
    c = pair.agg(a.alias("a"), b.alias("b")).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab")).join(F.broadcast(n)).where("a > 0 AND b > 0")
    cov = (F.col("ab") / F.col("m") - F.col("a") * F.col("b") / F.col("m") / F.col("m")) / F.col("m") / (F.col("a") * F.col("b") / F.col("m") / F.col("m"))
    return se.union(c.select("feature", F.lit("cov"), cov))


def split_fractions(pilot: DataFrame, n: Column, parents: tuple[str, str] = ("MIX.SC", "MIX.SE"), alleles: tuple[str, str] = ("HYB.SC", "HYB.SE")) -> DataFrame:
    """(r, fraction, features, correlation): the best split of the hybrid's units from pooled medians.

    A: n (hybrid) times the variance of the alleles' difference; B: the parents' variances added up. Their medians over features with
    a positive A and both defined are pooled before the ratio, as is the median correlation of the alleles.
    """
    wide = pilot.groupBy("feature").pivot("dataset", [*parents, *alleles, "cov"]).agg(F.first("se"))
    p, q, x, y = (F.col(f"`{c}`") for c in (*parents, *alleles))
    rows = wide.select((n * (x * x + y * y - 2 * F.col("cov"))).alias("a"), (p * p + q * q).alias("b"), F.try_divide(F.col("cov"), x * y).alias("rho"))
    rows = rows.where("a > 0 AND b IS NOT NULL")
    pooled = rows.agg(F.percentile("a", 0.5).alias("a"), F.percentile("b", 0.5).alias("b"), F.percentile("rho", 0.5).alias("correlation"), F.count("*").alias("features"))
    r = pooled.withColumn("r", F.col("b") * n / F.col("a"))
    return r.select("r", split_fraction(F.col("r")).alias("fraction"), "features", "correlation")


def partition_report(sided: DataFrame, least: int) -> DataFrame:
    """(dataset, n_cis, n_trans, below_least): sizes of a split's sides (c, t)."""
    per = sided.groupBy("dataset").agg(F.count_if(F.col("side") == "c").alias("n_cis"), F.count_if(F.col("side") == "t").alias("n_trans"))
    return per.withColumn("below_least", F.least("n_cis", "n_trans") < least)


def share_offsets(shares: DataFrame, subset: str) -> DataFrame:
    """(subset, offset, difference): log2 of the mean share over its rest, of each subset, and how far it is from that of all rows."""
    log = F.log2(F.avg("share") / (1 - F.avg("share")))
    per = shares.groupBy(F.col(subset).alias("subset")).agg(log.alias("offset"))
    return per.join(F.broadcast(shares.agg(log.alias("_all")))).select("subset", "offset", (F.col("offset") - F.col("_all")).alias("difference"))


def structural_correlation(parts: DataFrame) -> DataFrame:
    """(observed, forced, excess): correlation of an axis f with the sum s = m + f, from (vm, vf, cmf), and what it would be if m and f were independent of each other in that sum."""
    vs = F.col("vm") + F.col("vf") + 2 * F.col("cmf")
    scale = F.sqrt(F.when(F.col("vf") * vs > 0, F.col("vf") * vs))
    seen, forced = (F.col("cmf") + F.col("vf")) / scale, F.col("vf") / scale
    return parts.select(seen.alias("observed"), forced.alias("forced"), (seen - forced).alias("excess"))


def rejection_table(long: DataFrame, keys: list[str], quantity: str, p: str, level: float = 0.05) -> DataFrame:
    """A row for each of the keys, a column for each quantity: the share of p-values under the level."""
    return long.groupBy(*keys).pivot(quantity).agg(F.avg((F.col(p) < level).cast("int")))


def common_features(fits: DataFrame) -> DataFrame:
    """The features that all datasets of the table have."""
    n = fits.agg(F.count_distinct("dataset").alias("_n"))
    per = fits.groupBy("feature").agg(F.count_distinct("dataset").alias("_c"))
    return per.join(F.broadcast(n), F.col("_c") == F.col("_n")).select("feature")


def prefixed_union(tables: dict[str, DataFrame], column: str = "unit") -> DataFrame:
    """Tables of one layout under each other, the units' names led by the tables'."""
    out = None
    for prefix, df in tables.items():
        df = df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))
        out = df if out is None else out.unionByName(df)
    return out


def either_criterion(df: DataFrame, key: str, score: str, most: int, other: Column) -> DataFrame:
    """Keys among the `most` highest scores, ties by key, or for which `other` holds."""
    top = df.orderBy(F.desc_nulls_last(score), key).limit(most).select(key)
    return top.union(df.where(other).select(key)).distinct()


def cumulative_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, rank, percent, cumulative) of a short table, e.g. the variances of components, greatest first."""
    order = Window.orderBy(F.desc(value), key)
    total = Window.partitionBy()
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    percent = 100 * F.col(value) / F.sum(value).over(total)
    return df.select(key, F.row_number().over(order).alias("rank"), percent.alias("percent"), (100 * F.sum(value).over(up) / F.sum(value).over(total)).alias("cumulative"))


def top_each(df: DataFrame, groups: list[str], score: str, key: str, most: int) -> DataFrame:
    """The rows of the `most` highest scores of each group, ties by key, with their rank; Spark keeps only those while it sorts."""
    order = Window.partitionBy(*groups).orderBy(F.desc_nulls_last(score), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def strongest(df: DataFrame, effect: str, key: str, most: int) -> DataFrame:
    """The `most` rows of the greatest absolute effects, missing ones last, ties by key: a report of fixed length."""
    return df.orderBy(F.desc_nulls_last(F.abs(effect)), key).limit(most)


def signed_rank(df: DataFrame, difference: str, groups: list[str]) -> DataFrame:
    """(groups, n, v, z): the one-sample signed-rank test; zeros are left out, ties share ranks, z has the continuity and tie corrections."""
    d = df.where(F.col(difference) != 0).select(*groups, F.abs(difference).alias("_a"), (F.col(difference) > 0).alias("_up"))
    ranked = stats.average_ranks(d, "_a", "_r", groups)
    per = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_up"), F.col("_r")).otherwise(0.0)).alias("v"))
    ties = d.groupBy(*groups, "_a").agg(F.count("*").alias("t")).groupBy(*groups).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    away = F.col("v") - n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return per.join(ties, groups).select(*groups, "n", "v", F.try_divide(away - 0.5 * F.signum(away), sd).alias("z"))


def component_sets(classed: DataFrame, cls: str, effects: dict[str, str]) -> DataFrame:
    """(set, feature columns): features whose class names a component (cis, trans), by the sign of their own effect of that component."""
    out = None
    for component, effect in effects.items():
        own = classed.where(F.lower(cls).contains(component) | (F.col(cls) == "Compensatory")).where(F.col(effect) != 0)
        own = own.withColumn("set", F.concat(F.lit(component + "_"), F.when(F.col(effect) > 0, "up").otherwise("down")))
        out = own if out is None else out.unionByName(own)
    return out


def contained(windows: DataFrame, track: DataFrame, width: int = 1000) -> DataFrame:
    """Windows (seqid, start, end, ...) joined with the track's positions (seqid, pos, ...) in them.

    The join is by seqid and bin of `width` positions; a window comes once for each bin that it reaches into, so no position
    meets a window of another part of its sequence.
    """
    cut = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    at = track.withColumnRenamed("seqid", "_s").withColumn("_p", F.floor(F.col("pos") / width))
    return cut.join(at, (F.col("seqid") == F.col("_s")) & (F.col("_b") == F.col("_p")) & F.col("pos").between(F.col("start"), F.col("end"))).drop("_b", "_s", "_p")


def mean_occupancy(windows: DataFrame, track: DataFrame, value: str, keys: list[str], width: int = 1000) -> DataFrame:
    """(keys, n, occupancy): mean of the track's values within each window, null where there are none."""
    per = contained(windows, track, width).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("occupancy"))
    return windows.select(*keys).distinct().join(per, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "occupancy")


def ratio_report(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, share_above, zero, median) of the within-to-between ratio of noise, from (within, between)."""
    r = F.when(F.col("between") > 0, F.greatest("within", F.lit(0.0)) / F.col("between"))
    return rows.groupBy(*groups).agg(F.count(r).alias("n"), F.avg((r > 1).cast("int")).alias("share_above"), F.count_if(r == 0).alias("zero"), F.percentile(r, 0.5).alias("median"))


def cluster_stability(df: DataFrame, vector: str, key: str, k: int, draws: int, seed: int = 1) -> DataFrame:
    """(draw, n, ari): agreement of KMeans on hashed bootstrap weights with KMeans on all rows, over the rows drawn.

    A row's weight in a draw is Poisson with mean 1 by a hash of its key, so it doesn't depend on the partitioning.
    """
    from pyspark.ml.clustering import KMeans

    from dispersa.operators.states import adjusted_rand

    base = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="a").fit(df).transform(df)
    out = None
    for draw in range(1, draws + 1):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
        w, total, term = F.lit(0.0), 0.0, 2.718281828459045**-1
        for n in range(1, 8):
            total += term
            w = w + F.when(u >= total, 1.0).otherwise(0.0)
            term /= n
        drawn = base.withColumn("_w", w).where("_w > 0")
        again = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="b", weightCol="_w").fit(drawn).transform(drawn)
        row = adjusted_rand(again, "a", "b").select(F.lit(draw).alias("draw"), "n", "ari")
        out = row if out is None else out.union(row)
    return out


def two_normals(df: DataFrame, value: str, key: str, seed: int = 1) -> DataFrame:
    """(key, value, pole, posterior): a mixture of two normals of an axis' loadings; pole 0 is that of the lesser mean, null up to a posterior of one half."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=[value], outputCol="_v").transform(df.select(key, value).where(F.col(value).isNotNull()))
    model = GaussianMixture(k=2, seed=seed, featuresCol="_v", probabilityCol="_p").fit(rows)
    means = [float(g.mean[0]) for g in model.gaussians]
    low, high = (0, 1) if means[0] <= means[1] else (1, 0)
    p = vector_to_array("_p")
    out = model.transform(rows).select(key, value, p[low].alias("_l"), p[high].alias("_h"))
    return out.select(key, value, F.when(F.col("_l") > 0.5, 0).when(F.col("_h") > 0.5, 1).alias("pole"), F.greatest("_l", "_h").alias("posterior"))


def tukey_pairs(df: DataFrame, x: str, group: str, sig: float = 0.05) -> DataFrame:
    """(first, second, diff, q, p): all pairs of groups by the studentised range, if the analysis of variance is significant; else no row.

    diff is the second's mean less the first's. Null groups and values are left out. Pairs are of groups, never of rows.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
    per = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    whole = per.agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("t"))
    df1, df2 = F.col("k") - 1, F.col("all") - F.col("k")
    mse = F.try_divide(F.col("within"), df2)
    between = F.col("t") - F.col("s") * F.col("s") / F.col("all")
    test = whole.select("k", df2.alias("df2"), mse.alias("mse"), tails.f_p(F.try_divide(F.try_divide(between, df1), mse), df1, df2).alias("pf")).where(F.col("pf") < sig)
    a, b = per.select(F.col("g").alias("first"), F.col("n").alias("na"), F.col("m").alias("ma")), per.select(F.col("g").alias("second"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    pairs = a.join(b, F.col("first") < F.col("second")).join(test)
    q = F.abs(F.col("mb") - F.col("ma")) / F.sqrt(F.col("mse") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    return pairs.withColumn("q", q).select("first", "second", (F.col("mb") - F.col("ma")).alias("diff"), "q", tails.tukey_p(F.col("q"), F.col("k"), F.col("df2")).alias("p"))
