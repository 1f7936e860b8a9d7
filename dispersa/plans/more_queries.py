"""Further queries: inference tables, nulls, promoters' statistics, unit states and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.functions import stats
from dispersa.operators import coexpression, contrasts, enrichment, fitting, inference, offsets, qc, sequences, smoothing, states
from dispersa.plans.bindings import counts
from dispersa.plans.count_queries import _MODES, STATS, WITH, _expo, _pairs, _units
from dispersa.plans.registry import register, rounded
from dispersa.plans.class_queries import PARTS_SQL, part_tests
from dispersa.session import read_table

_CLS = """, fc AS (SELECT dataset, feature, mu, greatest(disp_moment, 0) AS disp, CASE WHEN disp_moment > 0.02 THEN 1 WHEN n_expr > 150 THEN 2 ELSE 3 END AS class, n_expr >= 120 AS info_ok FROM mom)"""


def _classed_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Moment fits with classes by simple cuts, in place of likelihood classes, so that SQL can follow."""
    s = fitting.sufficient(counts(spark, sf), _expo(spark, sf))
    m = fitting.moment_fit(s).join(s.select("dataset", "feature", "n_expr"), ["dataset", "feature"])
    kind = F.when(F.col("disp_moment") > 0.02, 1).when(F.col("n_expr") > 150, 2).otherwise(3)
    return m.select("dataset", "feature", "mu", F.greatest("disp_moment", F.lit(0.0)).alias("disp"), kind.alias("class"), (F.col("n_expr") >= 120).alias("info_ok"))


def _groups(spark):
    return contrasts.mode_groups(spark, {m: contrasts.MODE_GROUPS[m] for m in ("total", "mid", "par_sc", "par_se")})


@register("d11_eligibility", f"""{STATS}{_CLS}, mg AS ({_MODES}) SELECT feature, mode, count_if(info_ok AND mu IS NOT NULL) = any_value(k) AS mean_ok, count_if(class IN (1, 2)) = any_value(k) AS raw_ok, count_if(class = 1) = any_value(k) AS log_ok, count_if(class = 2) > 0 AS poisson_like FROM fc JOIN mg USING (dataset) GROUP BY ALL""")
def eligibility(spark, sf):
    f = _classed_fits(spark, sf)
    return inference.eligibility(f.drop("info_ok"), _groups(spark), f.select("dataset", "feature", "info_ok"))


@register("d12_exclusions", f"""{STATS}{_CLS}, mg AS ({_MODES}), r AS (SELECT feature, mode, CASE WHEN count(class) < any_value(k) THEN 'n' WHEN bool_or(class = 3) THEN 'u' WHEN bool_or(class = 2) THEN 'z' ELSE 'e' END AS why FROM fc JOIN mg USING (dataset) GROUP BY ALL)
SELECT mode, count(*) AS features, CAST(count_if(why = 'e') AS BIGINT) AS eligible, CAST(count_if(why = 'n') AS BIGINT) AS no_fit, CAST(count_if(why = 'u') AS BIGINT) AS uninformative, CAST(count_if(why = 'z') AS BIGINT) AS near_zero FROM r GROUP BY mode""")
def exclusions(spark, sf):
    return inference.exclusion_counts(_classed_fits(spark, sf), _groups(spark))


@register("d17_reliability", f"{STATS}{_CLS} SELECT feature, round(min(disp * mu / (1 + disp * mu)), 6) AS reliability FROM fc GROUP BY feature")
def reliability(spark, sf):
    return rounded(fitting.reliability(_classed_fits(spark, sf)))


@register("d2_weighted_fits")
def weighted(spark, sf):
    return rounded(inference.weighted_fits(counts(spark, sf), _expo(spark, sf)), 4)


@register("e3_share_corrections", f"""{STATS.split('ds AS')[0].rstrip().rstrip(',')}, pr AS (SELECT coalesce(x.lib, 0) AS a, coalesce(z.lib, 0) AS b FROM (SELECT * FROM units WHERE dataset = 'HYB.SC') x FULL JOIN (SELECT * FROM units WHERE dataset = 'HYB.SE') z ON x.unit = z.unit),
c AS (SELECT a / (a + b) AS c, a / (a + b) * (b / (a + b)) / (a + b - 1) AS v FROM pr WHERE a + b > 1), t AS (SELECT avg(c) AS cbar, greatest(var_samp(c) - avg(v), 0) AS var_c FROM c)
SELECT DISTINCT dataset, round(CASE dataset WHEN 'HYB.SC' THEN var_c / (cbar * cbar) WHEN 'HYB.SE' THEN var_c / ((1 - cbar) * (1 - cbar)) ELSE 0 END, 6) AS share_r FROM units, t""")
def corrections(spark, sf):
    u = _units(spark, sf)
    return rounded(offsets.share_correction(u.select("dataset").distinct(), offsets.share_terms(offsets.allele_pairs(u))))


@register("i10_null_dispersions", f"""{STATS}{_CLS}, mg AS ({_MODES}), r AS (SELECT feature, mode, dataset, weight, disp AS phi FROM fc JOIN mg USING (dataset)),
s AS (SELECT feature, mode, sum(weight * CASE WHEN phi > 0 THEN log2(phi + CASE WHEN phi > 0 THEN 0 ELSE 1 END) END) AS d, sum(weight * weight) AS n, bool_and(phi > 0) AS ok FROM r GROUP BY ALL)
SELECT r.feature, r.mode, r.dataset, round(CASE WHEN ok THEN 2 ** (log2(CASE WHEN phi > 0 THEN phi ELSE 1 END) - weight * d / n) END, 6) AS null_log2 FROM r JOIN s ON r.feature = s.feature AND r.mode = s.mode""")
def nulls(spark, sf):
    rows = _classed_fits(spark, sf).join(_groups(spark), "dataset").select("feature", "mode", "dataset", "weight", F.col("disp").alias("phi"))
    return rounded(inference.null_dispersions(rows, ["feature", "mode"]).select("feature", "mode", "dataset", "null_log2"))


@register("i10_null_raw")
def nulls_raw(spark, sf):
    rows = _classed_fits(spark, sf).join(_groups(spark), "dataset").select("feature", "mode", "dataset", "weight", F.col("disp").alias("phi"))
    return rounded(inference.null_raw_dispersions(rows, ["feature", "mode"]).select("feature", "mode", "dataset", "null_raw"))


#: Simulated draws of a null, as many as the reference's N.SIM.
SIMULATED = 2000


@register("i11_parametric_p")
def parametric(spark, sf):
    fits = fitting.fit_dispersions(counts(spark, sf), _expo(spark, sf))
    return rounded(inference.parametric_p(fits, _expo(spark, sf), contrasts.MODE_GROUPS["total"], SIMULATED, 3), 4)


_STATUS = f"""{PARTS_SQL}, g AS (SELECT p_partkey AS feature, family AS mode, 'disp' AS quantity, p < 0.7 AS eligible, p, p2, est FROM pv), r AS (SELECT *, est IS NOT NULL AND p2 < 0.8 AS run FROM g)"""


def _status(spark, sf):
    t = part_tests(spark, sf).select(F.col("p_partkey").alias("feature"), F.col("family").alias("mode"), F.lit("disp").alias("quantity"), (F.col("p") < 0.7).alias("eligible"), "p", "p2", "est")
    est = t.where("p2 < 0.8").select("feature", "mode", "quantity", "est", F.when(F.col("est") > -1, F.abs("est")).alias("se"))
    tests = t.where("p2 < 0.6").select("feature", "mode", "quantity", "p", F.col("p").alias("q"))
    return inference.status_table(t.select("feature", "mode", "quantity", "eligible"), est, tests, 0.1)


@register("i15_status", f"{_STATUS} SELECT feature, mode, quantity, eligible, run, run AS est_ok, run AND est > -1 AS ci_ok, p2 < 0.6 AS test_ok, round(CASE WHEN p2 < 0.6 THEN p END, 6) AS q, p2 < 0.6 AND p < 0.1 AS sig FROM r")
def status(spark, sf):
    return rounded(_status(spark, sf))


@register("i15_status_tally", f"""{_STATUS} SELECT quantity, mode, CAST(count_if(eligible) AS BIGINT) AS eligible, CAST(count_if(run) AS BIGINT) AS run, CAST(count_if(run) AS BIGINT) AS est_ok, CAST(count_if(run AND est > -1) AS BIGINT) AS ci_ok,
CAST(count_if(p2 < 0.6) AS BIGINT) AS test_ok, CAST(count_if(p2 < 0.6 AND p < 0.1) AS BIGINT) AS sig FROM r GROUP BY ALL""")
def status_tally(spark, sf):
    return inference.status_tally(_status(spark, sf))


@register("i19_floors", f"{PARTS_SQL}, f AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.5]) AS floor) SELECT floor, count(est) AS n, round(quantile_cont(abs(est), 0.5), 6) AS median_se FROM f LEFT JOIN pv ON p >= floor GROUP BY floor")
def floors(spark, sf):
    t = part_tests(spark, sf).select("p", F.abs("est").alias("se"))
    return rounded(inference.floor_table(t, "p", "se", spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.5)], "floor double")))


@register("i21_mixture_power")
def power(spark, sf):
    t = part_tests(spark, sf)
    return rounded(inference.mixture_power(t.select(F.col("p_partkey").alias("id"), "p"), t.select(F.col("p_partkey").alias("id"), (F.col("p2") / 200).alias("p")), 0.05, 0.2, 10, 7))


@register("i26_calibration", f"{PARTS_SQL} SELECT family, count(*) AS n, round(avg(CAST(p < 0.05 AS INT)), 6) AS below_05, round(avg(CAST(p < 0.2 AS INT)), 6) AS below_20 FROM pv GROUP BY family")
def calibrated(spark, sf):
    return rounded(inference.calibration(part_tests(spark, sf), ["family"], "p"))


@register("k15_extrinsic", f"""{PARTS_SQL} SELECT p_partkey AS feature, round(est / 2 / p, 6) AS rho_true, round(least(greatest(est / 2 / p, 0), 1), 6) AS extrinsic, round(1 - least(greatest(est / 2 / p, 0), 1), 6) AS intrinsic, est / 2 / p < 0 OR est / 2 / p > 1 AS clipped FROM pv WHERE p >= 0.1""")
def extrinsic(spark, sf):
    t = part_tests(spark, sf).select(F.col("p_partkey").alias("feature"), (F.col("est") / 2).alias("rho_obs"), F.col("p").alias("attn"))
    return rounded(smoothing.extrinsic_fractions(t))


@register("x14_partial_correlation", """WITH g AS (SELECT l_returnflag AS k, corr(l_quantity, l_discount) AS r, corr(l_quantity, l_tax) AS ra, corr(l_discount, l_tax) AS rb FROM lineitem GROUP BY 1) SELECT k, round(r, 6) AS r, round((r - ra * rb) / sqrt((1 - ra * ra) * (1 - rb * rb)), 6) AS partial FROM g""")
def partial(spark, sf):
    line = read_table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k")
    return rounded(coexpression.partial_correlation(line, "l_quantity", "l_discount", "l_tax", ["k"]))


@register("p7_divergence", f"{PARTS_SQL} SELECT a.p_partkey AS k, round(a.est - b.est, 6) AS est_delta, round(b.p - a.p, 6) AS p_delta FROM pv a JOIN pv b ON a.p_partkey = b.p_partkey + 1")
def diverged(spark, sf):
    t = part_tests(spark, sf).select(F.col("p_partkey").alias("k"), "est", "p")
    return rounded(sequences.divergence(t, t.withColumn("k", F.col("k") + 1), "k", ["est", "p"], ["p"]))


@register("p8_partial_association", """WITH s AS (SELECT ln(l_extendedprice) AS y, l_discount AS x, ln(l_quantity) AS z FROM lineitem), c AS (SELECT count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM s),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM c) SELECT n, round(bx, 6) AS estimate, round((bx * xy + bz * zy) / yy - zy * zy / (zz * yy), 6) AS r2_partial FROM b""")
def association(spark, sf):
    return rounded(sequences.partial_association(read_table(spark, sf, "lineitem"), "l_extendedprice", "l_discount", "l_quantity"))


@register("p9_sign_concordance", f"""{PARTS_SQL}, s AS (SELECT count(*) AS n, count_if(sign(est) = -sign(est2)) AS c FROM pv WHERE est <> 0 AND est2 <> 0), k AS (SELECT n, c, unnest(range(CAST(c AS BIGINT), n + 1)) AS k FROM s)
SELECT n, CAST(c AS BIGINT) AS concordant, round(c / n, 6) AS share, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p FROM k GROUP BY n, c""")
def concordance(spark, sf):
    return rounded(sequences.sign_concordance(part_tests(spark, sf), "est", "est2", -1))


@register("p10_concordance_bins", f"""{PARTS_SQL}, e AS (SELECT p_partkey, abs(est) AS m, sign(est) = -sign(est2) AS c FROM pv WHERE est <> 0 AND est2 <> 0), b AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY m, p_partkey) / count(*) OVER () * 10) AS BIGINT) AS bin FROM e),
g AS (SELECT bin, count(*) AS n, CAST(count_if(c) AS BIGINT) AS concordant, avg(m) AS mag_mean FROM b GROUP BY bin)
SELECT bin, n, concordant, round(mag_mean, 6) AS mag_mean, round(concordant / n, 6) AS share, round(greatest(0, concordant / n - 1.96 * sqrt(concordant / n * (1 - concordant / n) / n)), 6) AS ci_lo, round(least(1, concordant / n + 1.96 * sqrt(concordant / n * (1 - concordant / n) / n)), 6) AS ci_hi FROM g""")
def binned(spark, sf):
    return rounded(sequences.concordance_bins(part_tests(spark, sf), "est", "est2", -1, 10, "p_partkey"))


@register("p11_candidates", f"{PARTS_SQL}, r AS (SELECT * FROM pv WHERE family IN (SELECT min(p_type) FROM part)), q AS (SELECT quantile_cont(abs(est), 0.9) AS q FROM r) SELECT p_partkey, family, round(est, 6) AS est FROM r, q WHERE abs(est) >= q")
def candidates(spark, sf):
    t = part_tests(spark, sf)
    first = t.agg(F.min("family")).first()[0]
    return rounded(sequences.top_candidates(t, "est", "family", [first], 0.9).select("p_partkey", "family", "est"))


@register("l1_normalised", f"{WITH} SELECT c.dataset, c.unit, feature, round(ln(1 + y / lib * 10000), 6) AS x FROM counts c JOIN units u ON c.dataset = u.dataset AND c.unit = u.unit")
def normalised(spark, sf):
    return rounded(states.normalised(counts(spark, sf)))


@register("l4_best_partition")
def partition(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = read_table(spark, sf, "embeddings")
    key = e.columns[0]
    out, k = states.best_partition(e.select(key, "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")), "v", [2, 4, 8], 5)
    return states.adjusted_rand(out, "label", "cluster").withColumn("k", F.lit(k)).withColumn("ari", F.round("ari", 6))


@register("l8_marker_tests", f"""{WITH}, v AS (SELECT unit, feature, ln(1 + y / lib * 10000) AS x FROM counts JOIN units USING (dataset, unit) WHERE dataset = 'MIX.SC'), cl AS (SELECT unit, CAST(unit AS BIGINT) % 3 AS cluster FROM units WHERE dataset = 'MIX.SC'),
d AS (SELECT cl.unit, cluster, f.feature, coalesce(round(x, 9), 0) AS x FROM cl CROSS JOIN (SELECT DISTINCT feature FROM v) f LEFT JOIN v ON v.unit = cl.unit AND v.feature = f.feature),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, x) AS t FROM d), f AS (SELECT feature, count(*) AS n, sum(t * t - 1) AS ties, sum(exp(x) - 1) AS s FROM r GROUP BY feature),
g AS (SELECT cluster, feature, count(*) AS n1, sum(r) AS w, sum(exp(x) - 1) AS s1 FROM r GROUP BY ALL), h AS (SELECT *, n - n1 AS n2, w - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 AS away FROM g JOIN f USING (feature))
SELECT cluster, feature, round(log2(s1 / n1 + 1) - log2((s - s1) / n2 + 1), 5) AS lfc, round((away - sign(away) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1)))), 5) AS z FROM h""")
def markers(spark, sf):
    x = states.normalised(counts(spark, sf).where("dataset = 'MIX.SC'")).withColumn("x", F.round("x", 9))
    cl = x.select("unit").distinct().withColumn("cluster", F.col("unit").cast("long") % 3)
    return rounded(states.marker_tests(x.select("unit", "feature", "x"), cl), 5)


@register("l9_module_scores")
def modules(spark, sf):
    x = states.normalised(counts(spark, sf).where("dataset = 'MIX.SC'"))
    return rounded(states.module_scores(x, x.select("feature").distinct().where("feature LIKE 'Brand#1%'"), 5, 3))


@register("l10_composition", "SELECT c_mktsegment AS g, c_nationkey AS k, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer GROUP BY 1, 2")
def composed(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k"))
    return rounded(states.composition(c, "g", "k"))


@register("l11_principal_axis", """WITH s AS (SELECT avg(l_quantity) AS ma, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_samp(l_extendedprice) AS sb, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(((l_quantity - ma) / sa + sign(r) * (l_extendedprice - mb) / sb) / sqrt(2), 5) AS axis FROM lineitem, s""")
def axis(spark, sf):
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(states.principal_axis(line, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "axis"), 5)


@register("g6_significant_counts", f"{PARTS_SQL} SELECT family AS set_name, CAST(count_if(p < 0.05) AS BIGINT) AS n FROM pv GROUP BY family")
def significant(spark, sf):
    return enrichment.significant_counts(part_tests(spark, sf).select(F.col("family").alias("set_name"), F.col("p").alias("q")))


@register("v3_adjusted_noise")
def adjusted(spark, sf):
    m = F.avg("l_quantity")
    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("feature")).agg(m.alias("mean"), (F.var_samp("l_quantity") / (m * m)).alias("cv2"))
    return rounded(smoothing.mean_adjusted_noise(s), 4)


@register("v4_against_base", """WITH s AS (SELECT l_returnflag AS source, l_partkey AS feature, round(avg(l_quantity), 9) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey AS feature, round(avg(l_quantity), 9) AS w FROM lineitem GROUP BY 1), j AS (SELECT source, v, w FROM s JOIN b USING (feature)),
r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY v) + (count(*) OVER (PARTITION BY source, v) - 1) / 2 AS rx, rank() OVER (PARTITION BY source ORDER BY w) + (count(*) OVER (PARTITION BY source, w) - 1) / 2 AS ry FROM j) SELECT source, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY source""")
def based(spark, sf):
    from dispersa.operators import agreement

    line = read_table(spark, sf, "lineitem")
    s = line.groupBy(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_quantity"), 9).alias("v"))
    b = line.groupBy(F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_quantity"), 9).alias("v"))
    return rounded(agreement.against_base(s, b, "v"))


@register("q8_allele_ratio", f"""{WITH}, r AS (SELECT log2(a.y / b.y) AS v FROM counts a JOIN counts b ON a.unit = b.unit AND a.feature = b.feature WHERE a.dataset = 'HYB.SC' AND b.dataset = 'HYB.SE')
SELECT count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM r""")
def ratio(spark, sf):
    c = counts(spark, sf)
    a, b = c.where("dataset = 'HYB.SC'").select("unit", "feature", F.col("y").alias("a")), c.where("dataset = 'HYB.SE'").select("unit", "feature", F.col("y").alias("b"))
    v = a.join(b, ["unit", "feature"]).select(stats.signed_log2_ratio(F.col("a"), F.col("b")).alias("v"))
    return rounded(v.agg(F.count("*").alias("n"), *[F.percentile("v", q / 100).alias(f"q{q}") for q in (25, 50, 75)]))
