"""Queries on clusters of units, covariates, rankings by variance and errors of row-wise correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.operators import agreement, bootstrap, clusters, fitting, inference, rowwise, smoothing, spectra, states
from dispersa.plans.axis_queries import _all_residuals, _residuals
from dispersa.plans.bindings import counts
from dispersa.plans.count_queries import STATS, WITH, _expo, _units
from dispersa.plans.registry import register, rounded
from dispersa.session import read_table
from dispersa.sources.results import checkpointed

#: Units that a cluster must have in a dataset.
LEAST = 5
VIEWS = (("MIX.SC", "HYB.SC"), ("MIX.SE", "HYB.SE"), ("MIX.SC", "MIX.SE"))


def dominant(c: DataFrame) -> DataFrame:
    """(dataset, unit, cluster): the manufacturer whose brands a unit has most counts of, the first of equals."""
    per = c.groupBy("dataset", "unit", F.substring("feature", 7, 1).cast("int").alias("m")).agg(F.sum("y").alias("s"))
    return per.groupBy("dataset", "unit").agg(F.min_by("m", F.struct((-F.col("s")).alias("s"), "m")).alias("cluster"))


CLUSTERS = f"""{WITH}, fam AS (SELECT dataset, unit, CAST(substr(feature, 7, 1) AS INT) AS m, sum(y) AS s FROM counts GROUP BY ALL),
clu AS (SELECT dataset, unit, arg_min(m, -s * 100 + m) AS cluster FROM fam GROUP BY ALL),
big AS (SELECT dataset, cluster, count(*) AS n FROM clu GROUP BY ALL HAVING count(*) >= {LEAST}),
bulk AS (SELECT dataset, cluster, feature, CAST(sum(y) AS DOUBLE) AS y FROM counts JOIN clu USING (dataset, unit) JOIN big USING (dataset, cluster) GROUP BY ALL)"""


@register("l7_large_clusters", f"{CLUSTERS} SELECT dataset, cluster, n FROM big")
def large(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.large_clusters(dominant(counts(spark, sf)), LEAST)


@register("l7_cluster_correlations", CLUSTERS + ", " + ", ".join(f"""x{i} AS (
  SELECT '{a}' AS dataset_a, '{b}' AS dataset_b, p.cluster AS cluster_a, q.cluster AS cluster_b, corr(coalesce(u.y, 0), coalesce(v.y, 0)) AS cor
  FROM (SELECT DISTINCT feature FROM counts WHERE dataset IN ('{a}', '{b}')) f, (SELECT cluster FROM big WHERE dataset = '{a}') p, (SELECT cluster FROM big WHERE dataset = '{b}') q
  LEFT JOIN bulk u ON u.dataset = '{a}' AND u.cluster = p.cluster AND u.feature = f.feature LEFT JOIN bulk v ON v.dataset = '{b}' AND v.cluster = q.cluster AND v.feature = f.feature GROUP BY ALL)"""
  for i, (a, b) in enumerate(VIEWS)) + " SELECT dataset_a, dataset_b, cluster_a, cluster_b, round(cor, 6) AS cor FROM (" + " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(len(VIEWS))) + ")")
def correlations(spark, sf):
    c = counts(spark, sf)
    return rounded(clusters.cluster_correlations(c, dominant(c), list(VIEWS), LEAST))


CROSSING = CLUSTERS + """, cr AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n FROM clu a JOIN clu b ON a.unit = b.unit WHERE a.dataset = 'HYB.SC' AND b.dataset = 'HYB.SE' GROUP BY ALL)"""


@register("l7_consistent_pairs", f"""{CROSSING}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb, sum(n) OVER () AS t FROM cr)
SELECT a, b, n, round(n / t, 6) AS share FROM r WHERE ra = 1 AND rb = 1""")
def consistent(spark, sf):
    return rounded(clusters.consistent_pairs(clusters.cluster_crossing(dominant(counts(spark, sf)), "HYB.SC", "HYB.SE")))


#: Scores of units: account balance as covariate, region as group.
UNIT_SCORES = "sc AS (SELECT CAST(c_custkey AS VARCHAR) AS unit, c_acctbal AS x, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_RANK = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0}) - 1) / 2"
DIAGNOSED = f"""{STATS}, {UNIT_SCORES}, f AS (SELECT feature, mu, greatest(disp_moment, 0) AS d FROM mom WHERE dataset = 'MIX.SC'),
r0 AS (SELECT f.feature, e.unit, mu * expo AS m, d, coalesce(y, 0) AS y FROM f CROSS JOIN (SELECT * FROM expo WHERE dataset = 'MIX.SC') e LEFT JOIN (SELECT * FROM counts WHERE dataset = 'MIX.SC') c ON c.feature = f.feature AND c.unit = e.unit),
r1 AS (SELECT feature, unit, (y - m) / sqrt(m + d * m * m) AS r, x, g FROM r0 JOIN sc USING (unit)),
rk AS (SELECT feature, r, g, {_RANK.format('r')} AS ra, {_RANK.format('x')} AS rb, count(*) OVER (PARTITION BY feature, r) AS ties FROM r1),
sp AS (SELECT feature, count(*) AS n, corr(ra, rb) AS rho, avg(r) AS mean, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM rk GROUP BY feature),
gr AS (SELECT feature, g, count(*) AS k, avg(r) AS m, var_pop(r) AS v, sum(ra) AS s FROM rk GROUP BY ALL),
ga AS (SELECT feature, count(*) AS groups, sum(k * v) AS within, sum(s * s / k) AS b FROM gr GROUP BY feature),
gb AS (SELECT feature, sum(k * (m - mean) * (m - mean)) AS between FROM gr JOIN sp USING (feature) GROUP BY feature),
dg AS (SELECT feature, n, rho, between / (between + within) AS eta2, (12.0 / (n * (n + 1.0)) * b - 3 * (n + 1)) / (1 - tie / (CAST(n AS DOUBLE) * n * n - n)) AS h, groups FROM sp JOIN ga USING (feature) JOIN gb USING (feature))"""


def _diagnosed(spark, sf):
    unit, nation = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), read_table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    scores = unit.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("unit"), F.col("c_acctbal").cast("double").alias("x"), F.col("n_regionkey").alias("group"))
    return clusters.covariate_diagnostic(_residuals(spark, sf, "MIX.SC")[1], scores)


# five regions have four degrees of freedom, for which the tail of chi-squared is a closed form
@register("l13_covariate_diagnostic", f"""{DIAGNOSED}, p AS (SELECT *, exp(-h / 2) * (1 + h / 2) AS hp FROM dg), q AS (SELECT *, count(*) OVER () AS t, count(*) OVER (ORDER BY hp) AS k FROM p)
SELECT feature, n, round(rho, 6) AS rho, round(eta2, 6) AS eta2, round(h, 6) AS h, round(hp, 6) AS h_p, round(least(1.0, min(hp * t / k) OVER (ORDER BY hp DESC)), 6) AS h_q FROM q""")
def diagnosed(spark, sf):
    return rounded(_diagnosed(spark, sf).drop("rho_p", "rho_q"))


@register("l13_diagnostic_summary")
def diagnostic_summary(spark, sf):
    return rounded(clusters.diagnostic_summary(checkpointed(_diagnosed(spark, sf))))


RANKED = f"""{WITH}, nu AS (SELECT dataset, CAST(count(*) AS DOUBLE) AS n FROM units GROUP BY dataset),
mo AS (SELECT dataset, feature, n, sum(y) / n AS mean, (sum(y * y) - n * (sum(y) / n) * (sum(y) / n)) / (n - 1) AS var, count(*) AS nz FROM counts JOIN nu USING (dataset) GROUP BY dataset, feature, n),
lg AS (SELECT *, log10(mean) AS x, log10(mean) * log10(mean) AS z, log10(var) AS w FROM mo WHERE mean > 0 AND var > 0),
cv AS (SELECT dataset, avg(x) AS mx, avg(z) AS mz, avg(w) AS mw, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, w) AS xw, covar_pop(z, w) AS zw FROM lg GROUP BY dataset),
ln AS (SELECT dataset, (zz * xw - xz * zw) / (xx * zz - xz * xz) AS bx, (xx * zw - xz * xw) / (xx * zz - xz * xz) AS bz, mx, mz, mw FROM cv),
ex AS (SELECT lg.*, pow(10.0, mw - bx * mx - bz * mz + bx * x + bz * z) AS expected FROM lg JOIN ln USING (dataset)),
st2 AS (SELECT e.dataset, e.feature, sum(pow(least((y - mean) / sqrt(expected), sqrt(n)), 2)) AS s FROM ex e JOIN counts c ON c.dataset = e.dataset AND c.feature = e.feature GROUP BY ALL),
vr AS (SELECT dataset, feature, mean, var, expected, (s + (n - nz) * mean * mean / expected) / (n - 1) AS standardised FROM ex JOIN st2 USING (dataset, feature)),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(standardised, 9) DESC, feature) AS rank FROM vr)"""


@register("l2_variance_ranking", f"{RANKED} SELECT dataset, feature, round(mean, 6) AS mean, round(var, 6) AS var, round(expected, 6) AS expected, round(standardised, 6) AS standardised, rank FROM rk")
def ranking(spark, sf):
    return rounded(clusters.variance_ranking(counts(spark, sf), _units(spark, sf)))


@register("l2_variance_elbow", f"""{RANKED}, en AS (SELECT dataset, count(*) FILTER (standardised >= 1) >= 2 AS enough FROM rk GROUP BY dataset),
se AS (SELECT rk.* FROM rk JOIN en USING (dataset) WHERE NOT enough OR standardised >= 1), sp AS (SELECT dataset, max(standardised) - min(standardised) AS range, count(*) AS every FROM se GROUP BY dataset),
d AS (SELECT dataset, rank, standardised - lead(standardised) OVER (PARTITION BY dataset ORDER BY rank) AS d FROM se)
SELECT dataset, coalesce(max(rank) FILTER (d > 0.001 * range) + 1, any_value(every)) AS n_features FROM d JOIN sp USING (dataset) GROUP BY dataset""")
def elbow(spark, sf):
    return clusters.variance_elbow(clusters.variance_ranking(counts(spark, sf), _units(spark, sf)))


@register("l3_component_elbow")
def components(spark, sf):
    """The elbow of the leading components of scaled log-normalised counts."""
    c = counts(spark, sf).where("dataset = 'MIX.SC'")
    pairs = checkpointed(clusters.scaled_correlations(states.normalised(c), c.select("unit").distinct()))
    return clusters.component_elbow(spectra.leading_axes(pairs, "r", 15, diagonal=1.0))


#: Resamples of the registered query, as many as the reference takes.
ERROR_DRAWS = 300


def _allele_values(spark, sf):
    """Residuals of both alleles by feature and unit, their units as strata, and the features' attenuation."""
    u = _expo(spark, sf)
    fits = fitting.moment_fit(fitting.sufficient(counts(spark, sf), u)).where("dataset LIKE 'HYB.%' AND disp_moment > 0 AND mu > 0")
    share = F.col("disp_moment") * F.col("mu") / (1 + F.col("disp_moment") * F.col("mu"))
    parts = fits.groupBy("feature").agg(F.max(F.when(F.col("dataset") == "HYB.SC", share)).alias("a"), F.max(F.when(F.col("dataset") == "HYB.SE", share)).alias("b"))
    r = _all_residuals(spark, sf).where("dataset LIKE 'HYB.%'")
    a, b = (r.where(F.col("dataset") == d).select("feature", "unit", F.col("r").alias(name)) for d, name in (("HYB.SC", "a"), ("HYB.SE", "b")))
    # written: features with values are asked for before their draws
    return checkpointed(a.join(b, ["feature", "unit"])), bootstrap.coexpression_units(u).where("grp = 2"), smoothing.attenuation(parts.where("a IS NOT NULL AND b IS NOT NULL"))


@register("i20_correlation_errors")
def correlation_errors(spark, sf):
    return rounded(rowwise.correlation_errors(*_allele_values(spark, sf), draws=ERROR_DRAWS))


@register("i20_error_floors")
def error_floors(spark, sf):
    found = checkpointed(rowwise.correlation_errors(*_allele_values(spark, sf), draws=ERROR_DRAWS))
    floors = spark.range(1, 13).select((F.col("id") * 0.05).alias("floor"))
    raw, true = inference.floor_table(found, "attn", "se_obs", floors), inference.floor_table(found, "attn", "se_true", floors)
    return rounded(raw.withColumnRenamed("median_se", "median_se_obs").join(true.select("floor", F.col("median_se").alias("median_se_true")), "floor"))


def _published(spark, sf):
    """Brands of line items as raw ids of three published sources, the return flags, over customers; ids in lower case are aliases."""
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    order, part = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lower("p_brand"))
    counts = rows.groupBy(F.col("l_returnflag").alias("source"), raw.alias("id"), F.col("o_custkey").cast("string").alias("unit")).agg(F.count("*").alias("y"))
    aliases = part.groupBy(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("feature")).agg(F.min("p_partkey").alias("ord"))
    return counts, aliases, "^Brand#", 10, 20


PUBLISHED = """WITH raw AS (SELECT l_returnflag AS source, p_brand AS feature, o_custkey AS unit, count(*) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
deep AS (SELECT source, unit FROM raw GROUP BY ALL HAVING sum(y) >= 10), k AS (SELECT * FROM raw SEMI JOIN deep USING (source, unit)), fe AS (SELECT source, feature FROM k GROUP BY ALL HAVING count(*) >= 20),
kept AS (SELECT * FROM k SEMI JOIN fe USING (source, feature)), lib AS (SELECT source, unit, sum(y) AS lib FROM kept GROUP BY ALL), mean AS (SELECT source, avg(lib) AS m FROM lib GROUP BY source)"""


@register("v2_relative_exposures", f"{PUBLISHED} SELECT source AS dataset, CAST(unit AS VARCHAR) AS unit, lib, round(lib / m, 6) AS expo FROM lib JOIN mean USING (source)")
def relative(spark, sf):
    return rounded(agreement.relative_exposures(agreement.source_counts(*_published(spark, sf))))


@register("v2_fit_sources")
def fit_sources(spark, sf):
    return rounded(agreement.fit_sources(*_published(spark, sf)), 4)
