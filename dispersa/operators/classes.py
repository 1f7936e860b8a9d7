"""Classes from pairs of tests, their overlap, and summaries by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The levels in their order.
REGULATORY = ("Conserved", "Cis", "Trans", "Cis + Trans", "Compensatory")
DOMINANCE = ("Conserved", "Sc.Dominant", "Se.Dominant", "Overdominant", "Underdominant", "Additive")


def regulatory_class(p_cis: Column, p_trans: Column, cis: Column, trans: Column, sig: float = 0.05) -> Column:
    """Five classes by two tests; null without a p-value, Ambiguous where both are significant and a sign is unknown."""
    c, t, sign = p_cis < sig, p_trans < sig, F.signum(cis * trans)
    return (
        F.when(p_cis.isNull() | p_trans.isNull(), None)
        .when(~c & ~t, "Conserved").when(c & ~t, "Cis").when(~c & t, "Trans")
        .when(sign >= 0, "Cis + Trans").when(sign < 0, "Compensatory").otherwise("Ambiguous")
    )


def dominance_class(p_sc: Column, p_se: Column, sc: Column, se: Column, sig: float = 0.05) -> Column:
    """Six classes of a hybrid against each parent, with null and Ambiguous as above."""
    a, b, sign = p_sc < sig, p_se < sig, F.signum(F.signum(sc) + F.signum(se))
    return (
        F.when(p_sc.isNull() | p_se.isNull(), None)
        .when(~a & ~b, "Conserved").when(a & ~b, "Se.Dominant").when(~a & b, "Sc.Dominant")
        .when(sign > 0, "Overdominant").when(sign < 0, "Underdominant").when(sign == 0, "Additive").otherwise("Ambiguous")
    )


def clean_class(label: Column) -> Column:
    """Older spellings to the present one; Ambiguous to null."""
    return F.when(label == "Cis x Trans", "Compensatory").otherwise(F.nullif(label, F.lit("Ambiguous")))


def level_counts(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """(level, ord, n) with empty levels, in their order."""
    table = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(levels)], "level string, ord int")
    got = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    return table.join(got, "level", "left").na.fill(0, ["n"])


def log_factorials(spark, most: int) -> DataFrame:
    """(n, v): ln n! for 0..most."""
    return spark.range(0, most + 1).select(F.col("id").alias("n"), F.lgamma(F.col("id") + 1).alias("v")) if hasattr(F, "lgamma") else _summed_logs(spark, most)


def _summed_logs(spark, most: int, block: int = 4096) -> DataFrame:
    """Running sums of logs in blocks: sums within blocks, then the sum of all earlier blocks, a row each."""
    x = spark.range(0, most + 1).select(F.col("id").alias("n"), F.ln(F.greatest("id", F.lit(1))).alias("l"), F.floor(F.col("id") / block).alias("b"))
    inside = x.withColumn("w", F.sum("l").over(Window.partitionBy("b").orderBy("n")))
    base = x.groupBy("b").agg(F.sum("l").alias("t"))
    base = base.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    return inside.join(F.broadcast(base), "b").select("n", (F.col("base") + F.col("w")).alias("v"))


def overlap_ratios(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, obs, na, nb, n, exp, lor) of overlap_table, with the levels' own counts and the total, from counts of pairs of levels alone."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("obs"))
    na, nb = rows.groupBy("a").agg(F.sum("obs").alias("na")), rows.groupBy("b").agg(F.sum("obs").alias("nb"))
    total = rows.agg(F.sum("obs").alias("n"))
    grid = na.join(F.broadcast(nb)).join(rows, ["a", "b"], "left").na.fill(0, ["obs"]).join(F.broadcast(total))
    grid = grid.withColumn("exp", F.col("na") * F.col("nb") / F.col("n"))
    return grid.withColumn("lor", F.log2((F.col("obs") + 0.5) / (F.col("exp") + 0.5)))


def overlap_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, obs, exp, lor, p): counts of two classifications on the grid of their levels.

    lor = log2((obs + 1/2) / (exp + 1/2)). p is the two-sided hypergeometric p: the smaller tail twice, at most 1.
    """
    grid = overlap_ratios(df, a, b)
    low = F.greatest(F.lit(0), F.col("na") + F.col("nb") - F.col("n"))
    each = grid.withColumn("x", F.explode(F.sequence(low, F.least("na", "nb"))))
    lf = log_factorials(df.sparkSession, df.count())
    for name, value in (("f1", F.col("na")), ("f2", F.col("n") - F.col("na")), ("f3", F.col("nb")), ("f4", F.col("n") - F.col("nb")), ("f5", F.col("n")), ("f6", F.col("x")), ("f7", F.col("na") - F.col("x")), ("f8", F.col("nb") - F.col("x")), ("f9", F.col("n") - F.col("na") - F.col("nb") + F.col("x"))):
        each = each.withColumn("_k", value).join(lf.select(F.col("n").alias("_k"), F.col("v").alias(name)), "_k").drop("_k")
    pmf = F.exp(F.col("f1") + F.col("f2") + F.col("f3") + F.col("f4") - F.col("f5") - F.col("f6") - F.col("f7") - F.col("f8") - F.col("f9"))
    tails = each.groupBy("a", "b", "obs", "exp", "lor").agg(F.sum(F.when(F.col("x") >= F.col("obs"), pmf).otherwise(0.0)).alias("hi"), F.sum(F.when(F.col("x") <= F.col("obs"), pmf).otherwise(0.0)).alias("lo"))
    return tails.select("a", "b", "obs", "exp", "lor", F.least(F.lit(1.0), 2 * F.least("hi", "lo")).alias("p"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, concordance, chance, kappa) of two classifications of the same rows."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = rows.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    na, nb = rows.groupBy("a").agg(F.sum("c").alias("na")), rows.groupBy("b").agg(F.sum("c").alias("nb"))
    both = na.join(nb, na.a == nb.b).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    out = total.join(F.broadcast(both)).select("n", (F.col("same") / F.col("n")).alias("concordance"), (F.col("x") / F.col("n") / F.col("n")).alias("chance"))
    return out.withColumn("kappa", F.try_divide(F.col("concordance") - F.col("chance"), 1 - F.col("chance")))


def jaccard_by_class(df: DataFrame, a: str, b: str) -> DataFrame:
    """(level, jaccard): rows of a class in both classifications over rows of it in either."""
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    each = rows.withColumn("level", F.explode(F.array_distinct(F.array("a", "b")))).where("level IS NOT NULL")
    return each.groupBy("level").agg((F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("c")).otherwise(0)) / F.sum("c")).alias("jaccard"))


def class_moments(df: DataFrame, score: str, group: str) -> DataFrame:
    """(class, n, mean, var) of a score."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(group).alias("class")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("var"))


def class_slopes(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """(class, slope, intercept) of a line in each class."""
    return df.groupBy(F.col(group).alias("class")).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def outer_groups(df: DataFrame, score: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """df with `level`: low, average or high by two quantiles of the score."""
    cuts = df.agg(F.percentile(score, low).alias("_a"), F.percentile(score, high).alias("_b"))
    level = F.when(F.col(score) <= F.col("_a"), "low").when(F.col(score) >= F.col("_b"), "high").when(F.col(score).isNotNull(), "average")
    return df.join(F.broadcast(cuts)).withColumn("level", level).drop("_a", "_b")


def directions(df: DataFrame, est: str, q: str, sig: float = 0.05) -> DataFrame:
    """(direction, n): sig_pos, sig_neg or ns."""
    d = F.when((F.col(q) < sig) & (F.col(est) > 0), "sig_pos").when((F.col(q) < sig) & (F.col(est) < 0), "sig_neg").otherwise("ns")
    return df.where(F.col(est).isNotNull() & F.col(q).isNotNull()).groupBy(d.alias("direction")).agg(F.count("*").alias("n"))
