"""Statistical columns and grouped tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log2_or_negative_infinity(x: Column) -> Column:
    """log2 with -Infinity at 0, where the built-in gives null; null below 0."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log2(x))


def defined(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def signed_log2_ratio(a: Column, b: Column) -> Column:
    return F.log2(a / b)


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: missing values leave with their weights."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def average_ranks(df: DataFrame, value: str, into: str, groups: list[str]) -> DataFrame:
    """Ranks within groups with ties averaged, from counts of each value: rows of a value share one count."""
    per = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.withColumn(into, F.coalesce(F.sum("_c").over(order), F.lit(0)) + (F.col("_c") + 1) / 2).drop("_c")
    return df.join(ranks, [*groups, value], "left")


def spearman(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """(groups, n, rho) over rows where both are there; rho is null without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y)
    ranked = average_ranks(average_ranks(both, x, "_rx", groups), y, "_ry", groups)
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], into: str = "q") -> DataFrame:
    """q-values within families; null p-values are no tests and stay null.

    Each distinct p needs only how many tests have a p up to it: tests are counted by p first, and the
    running sums and minima go over those counts.
    """
    per = df.where(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*family).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*family).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*family)
    per = per.withColumn("_r", F.sum("_c").over(up)).withColumn("_m", F.sum("_c").over(whole))
    per = per.withColumn(into, F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_r")).over(down)))
    named = per.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(family)], "_p", into)
    same = [F.col(f).eqNullSafe(F.col(f"_f{i}")) for i, f in enumerate(family)]
    return df.join(named, [*same, F.col(p) == F.col("_p")], "left").drop("_p", *[f"_f{i}" for i in range(len(family))])


def add_one_p(obs: Column, null: Column) -> Column:
    """Aggregate: two-sided p over the null draws that are there; infinite draws count as extreme."""
    return (1 + F.count_if(F.abs(null) >= F.abs(obs))) / (1 + F.count(null))


def name_hash(name: str) -> Column:
    """h = (131 h + code) mod 2^31 - 1 over a name's characters."""
    codes = F.transform(F.split(F.col(name), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (131 * h + c) % 2147483647)


def one_way_anova(df: DataFrame, x: str, group: str) -> DataFrame:
    """(k, n, f, eta2) from grouped sums; p-values need the F tail."""
    per = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    t = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, total = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(between / (F.col("k") - 1), (total - between) / (F.col("n") - F.col("k")))
    return t.select("k", "n", f.alias("f"), F.try_divide(between, total).alias("eta2"))


def kruskal_wallis(df: DataFrame, x: str, group: str, keys: list[str]) -> DataFrame:
    """(keys, h): the rank test of several groups with the tie correction; null where all values are equal."""
    both = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(*keys, group, x)
    ranked = average_ranks(both, x, "_r", keys)
    per = ranked.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    ties = both.groupBy(*keys, x).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("b") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return (sums.join(ties, keys) if keys else sums.join(F.broadcast(ties))).select(*keys, h.alias("h"))


def rank_sum(df: DataFrame, x: str, first: Column, keys: list[str]) -> DataFrame:
    """(keys, n1, n2, u, z): two-sample rank sums with tie and continuity correction; `first` marks the first sample."""
    both = df.where(F.col(x).isNotNull()).select(*keys, first.alias("_one"), x)
    ranked = average_ranks(both, x, "_r", keys)
    per = ranked.groupBy(*keys).agg(F.count_if("_one").alias("n1"), F.count_if(~F.col("_one")).alias("n2"), F.sum(F.when(F.col("_one"), F.col("_r"))).alias("w"))
    ties = both.groupBy(*keys, x).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    u = F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2
    n = (F.col("n1") + F.col("n2")).cast("double")
    away = u - F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(away - F.signum(away) * 0.5, sd)
    return per.join(ties, keys).select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Correlation of two columns over the rows that have both, as an aggregate; null where one of them is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
