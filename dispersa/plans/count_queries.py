"""Queries on the count table: quality control, offsets, fits and contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.operators import coexpression, contrasts, fitting, offsets, qc, states
from dispersa.plans.bindings import COUNTS_SQL, counts, once
from dispersa.plans.registry import register, rounded

WITH = "WITH " + COUNTS_SQL.strip()
MERGED = ("Brand#12", "Brand#11", "Brand#13")
SPECIAL = "Brand#11"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "units", lambda: qc.unit_totals(counts(spark, sf)))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return offsets.allele_pairs(_units(spark, sf))


PAIRS = WITH + """,
pairs AS (SELECT coalesce(x.unit, z.unit) AS unit, coalesce(x.lib, 0) AS a, coalesce(z.lib, 0) AS b
  FROM (SELECT * FROM units WHERE dataset = 'HYB.SC') x FULL JOIN (SELECT * FROM units WHERE dataset = 'HYB.SE') z ON x.unit = z.unit)"""
EXPO = WITH + """,
depth AS (SELECT quantile_cont(lib, 0.5) AS d FROM units WHERE dataset IN ('MIX.SC', 'MIX.SE')),
hyb AS (SELECT unit, sum(lib) AS s FROM units WHERE dataset LIKE 'HYB%' GROUP BY unit),
expo AS (SELECT u.dataset, u.unit, u.lib, u.det, CASE WHEN u.dataset LIKE 'MIX%' THEN u.lib ELSE h.s / 2 END / depth.d AS expo
  FROM units u LEFT JOIN hyb h USING (unit) CROSS JOIN depth)"""
STATS = EXPO + """,
ds AS (SELECT dataset, count(*) AS n, sum(expo) AS se, sum(expo * expo) AS se2, sum(expo * expo * expo) AS se3 FROM expo GROUP BY dataset),
st AS (SELECT c.dataset, c.feature, sum(y) AS sy, sum(y * y) AS sy2, sum(y * expo) AS sye, count(*) AS n_expr
  FROM counts c JOIN expo e ON c.dataset = e.dataset AND c.unit = e.unit GROUP BY ALL),
ss AS (SELECT st.*, ds.n, ds.se, ds.se2, ds.se3, sy / se AS mu FROM st JOIN ds USING (dataset)),
mom AS (SELECT *, (sy2 - 2 * mu * sye + mu * mu * se2 - mu * (se - se2 / se)) / (mu * mu * (se2 - 2 * se3 / se + se2 * se2 / (se * se))) AS disp_moment FROM ss)"""
SHARE = PAIRS + """,
c AS (SELECT a / (a + b) AS c, a / (a + b) * (b / (a + b)) / (a + b - 1) AS v FROM pairs WHERE a + b > 1),
t0 AS (SELECT avg(c) AS cbar, var_samp(c) AS var_obs, avg(v) AS var_binom FROM c),
terms AS (SELECT *, greatest(var_obs - var_binom, 0) AS var_c, var_obs < var_binom AS negative FROM t0)"""


def _expo(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "expo", lambda: offsets.exposures(_units(spark, sf)))


@register("q1_unit_totals", f"{WITH} SELECT dataset, unit, lib, det FROM units")
def unit_totals(spark, sf):
    return _units(spark, sf)


@register("q2_minority_fraction", f"{PAIRS} SELECT unit, a, b, round(least(a, b) / (a + b), 6) AS fraction FROM pairs WHERE a > 0 AND b > 0")
def minority(spark, sf):
    u = _units(spark, sf)
    return rounded(qc.minority_fraction(u.where("dataset = 'HYB.SC'"), u.where("dataset = 'HYB.SE'")))


@register("q3_route_units", f"{PAIRS} SELECT unit, least(a, b) / (a + b) > 0.45 OR a < b AS drop_a, least(a, b) / (a + b) > 0.45 OR b <= a AS drop_b FROM pairs WHERE a > 0 AND b > 0")
def route(spark, sf):
    u = _units(spark, sf)
    return qc.route_units(qc.minority_fraction(u.where("dataset = 'HYB.SC'"), u.where("dataset = 'HYB.SE'")), 0.45)


@register("q4_exceedance", f"{WITH}, th AS (SELECT CAST(range AS BIGINT) AS threshold FROM range(0, 200)) SELECT threshold, count(lib) AS n FROM th LEFT JOIN units ON lib > threshold GROUP BY threshold")
def exceed(spark, sf):
    return qc.exceedance(_units(spark, sf), "lib", spark.range(200).withColumnRenamed("id", "threshold"))


@register("q5_density_valley")
def valley(spark, sf):
    u = _units(spark, sf)
    f = qc.minority_fraction(u.where("dataset = 'HYB.SC'"), u.where("dataset = 'HYB.SE'"))
    return rounded(qc.density_valley(f.select(F.log10("fraction").alias("x")), "x", adjust=0.5))


@register("q7_merge_features", f"{WITH} SELECT dataset, CASE WHEN feature = 'Brand#12' THEN 'Brand#11' ELSE feature END AS feature, unit, CAST(sum(y) AS BIGINT) AS y FROM counts WHERE feature <> 'Brand#13' GROUP BY ALL")
def merged(spark, sf):
    return qc.merge_features(counts(spark, sf), MERGED[0], MERGED[1], [MERGED[2]])


@register("q9_dying_units", f"""{WITH},
s AS (SELECT u.*, coalesce(c.y, 0) AS special FROM units u LEFT JOIN (SELECT * FROM counts WHERE feature = '{SPECIAL}') c ON u.dataset = c.dataset AND u.unit = c.unit),
l AS (SELECT *, ln(greatest(least(special / lib, 1 - 1e-4), 1e-4) / (1 - greatest(least(special / lib, 1 - 1e-4), 1e-4))) AS lg FROM s),
m AS (SELECT dataset, quantile_cont(lg, 0.5) AS med, quantile_cont(lib, 0.5) AS ml FROM l GROUP BY dataset),
d AS (SELECT l.dataset, quantile_cont(abs(lg - med), 0.5) * 1.4826 AS mad FROM l JOIN m USING (dataset) GROUP BY l.dataset)
SELECT l.dataset, unit, lib, det, special, lg > med + 0.5 * mad AND lib < ml AND mad > 0 AS flag FROM l JOIN m USING (dataset) JOIN d USING (dataset)""")
def dying(spark, sf):
    c = counts(spark, sf)
    special = c.where(F.col("feature") == SPECIAL).select("dataset", "unit", F.col("y").alias("special"))
    return qc.dying_units(qc.unit_totals(c).join(special, ["dataset", "unit"], "left").na.fill(0, ["special"]), k=0.5)


_CUTS = """
{0}m AS (SELECT dataset, quantile_cont(log10({1}), 0.5) AS med FROM units GROUP BY dataset),
{0}d AS (SELECT dataset, any_value(med) AS med, quantile_cont(abs(log10({1}) - med), 0.5) * 1.4826 AS mad FROM units JOIN {0}m USING (dataset) GROUP BY dataset)"""


@register("q10_lower_tail", f"{WITH}, {_CUTS.format('l', 'lib')} SELECT dataset, unit, lib, det, lib >= greatest(5, 10 ** (med - 1.5 * mad)) AS keep FROM units JOIN ld USING (dataset)")
def lower(spark, sf):
    return qc.lower_tail_keep(_units(spark, sf), k=1.5, least=5)


@register("q11_upper_outliers", f"{WITH}, {_CUTS.format('l', 'lib')}, {_CUTS.format('e', 'det')} SELECT dataset, unit, lib, det, log10(lib) > ld.med + 1.5 * ld.mad AS lib_hi, log10(det) > ed.med + 1.5 * ed.mad AS det_hi FROM units JOIN ld USING (dataset) JOIN ed USING (dataset)")
def upper(spark, sf):
    return qc.upper_outliers(_units(spark, sf), k=1.5)


@register("q12_share_z", f"""{PAIRS}, l AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN ln(a / b) END AS lg FROM pairs), m AS (SELECT quantile_cont(lg, 0.5) AS med FROM l)
SELECT unit, a, b, a = 0 OR b = 0 AS one, CASE WHEN a > 0 AND b > 0 THEN round(abs(lg - med) / sqrt(1 / ((a + b) * 0.25) + 0.01), 6) END AS z FROM l, m""")
def z(spark, sf):
    got = qc.share_z(_pairs(spark, sf), 0.5, 0.1)
    return rounded(got.select("unit", "a", "b", (F.col("z") == float("inf")).alias("one"), F.when(F.col("z") < float("inf"), F.col("z")).alias("z")))


_PASS = """,
dep AS (SELECT dataset, count(*) AS n_units, sum(lib) AS reads, avg(lib) AS per_unit FROM units GROUP BY dataset),
lim AS (SELECT 0.5 / min(per_unit) AS p, ceil(0.1 * min(n_units)) AS c FROM dep),
per AS (SELECT dataset, feature, sum(y) AS y, count(*) AS n FROM counts GROUP BY ALL),
grid AS (SELECT f.feature, dep.dataset, coalesce(y, 0) / reads >= p AND coalesce(n, 0) >= c AS ok
  FROM (SELECT DISTINCT feature FROM counts) f CROSS JOIN dep CROSS JOIN lim LEFT JOIN per ON per.dataset = dep.dataset AND per.feature = f.feature)"""


@register("q15_feature_pass", f"{WITH}{_PASS} SELECT feature, dataset, ok FROM grid")
def passes(spark, sf):
    return qc.feature_pass(counts(spark, sf), 0.5, 0.1)


@register("q16_pass_patterns", f"{WITH}{_PASS}, pat AS (SELECT feature, string_agg(CAST(CAST(ok AS INT) AS VARCHAR), '' ORDER BY dataset) AS pattern FROM grid GROUP BY feature) SELECT pattern, count(*) AS n FROM pat GROUP BY pattern")
def patterns(spark, sf):
    return qc.pass_patterns(qc.feature_pass(counts(spark, sf), 0.5, 0.1))


@register("q17_depths", f"{WITH} SELECT dataset, count(*) AS n_units, CAST(sum(lib) AS BIGINT) AS reads, round(avg(lib), 6) AS per_unit FROM units GROUP BY dataset")
def depths(spark, sf):
    return rounded(qc.dataset_depths(counts(spark, sf)))


@register("q19_filter_depth", f"""{WITH}, k AS (SELECT c.* FROM counts c JOIN units u USING (dataset, unit) WHERE u.lib >= 20), f AS (SELECT dataset, feature FROM k GROUP BY ALL HAVING count(*) >= 30)
SELECT k.dataset, k.feature, k.unit, k.y FROM k JOIN f USING (dataset, feature)""")
def depth_filter(spark, sf):
    return qc.filter_depth(counts(spark, sf), 20, 30)


@register("e1_exposures", f"{EXPO} SELECT dataset, unit, lib, det, round(expo, 6) AS expo FROM expo")
def expo(spark, sf):
    return rounded(_expo(spark, sf))


@register("e2_share_terms", f"""{SHARE} SELECT round(cbar, 6) AS cbar, round(var_obs, 6) AS var_obs, round(var_binom, 6) AS var_binom, round(var_c, 6) AS var_c, negative,
round(var_c / (cbar * cbar), 6) AS r_c, round(var_c / ((1 - cbar) * (1 - cbar)), 6) AS r_e, round(log2(cbar / (1 - cbar)), 6) AS "offset" FROM terms""")
def terms(spark, sf):
    return rounded(offsets.share_terms(_pairs(spark, sf)))


@register("e7_depth_split", f"""{WITH}, r AS (SELECT dataset, unit, lib, det, row_number() OVER (PARTITION BY dataset ORDER BY lib DESC, unit) AS rank_depth, count(*) OVER (PARTITION BY dataset) AS n FROM units),
k AS (SELECT dataset, any_value(n) AS n, CAST(round_even(0.4 * any_value(n), 0) AS BIGINT) AS k FROM r GROUP BY dataset),
p AS (SELECT DISTINCT dataset, CAST(round_even(1 + j * CASE WHEN k > 1 THEN (n - 1) / (k - 1) ELSE 0 END, 0) AS BIGINT) AS rank_depth FROM (SELECT *, unnest(range(k)) AS j FROM k))
SELECT r.dataset, r.rank_depth, unit, lib, det, CASE WHEN p.rank_depth IS NULL THEN 't' ELSE 'c' END AS side FROM r LEFT JOIN p ON r.dataset = p.dataset AND r.rank_depth = p.rank_depth""")
def split(spark, sf):
    got = offsets.depth_split(offsets.depth_order(_units(spark, sf)), 0.4)
    return got.select("dataset", F.col("rank_depth").cast("long").alias("rank_depth"), "unit", "lib", "det", "side")


@register("d2_moment_fit", f"{STATS} SELECT dataset, feature, round(mu, 6) AS mu, round(disp_moment, 6) AS disp_moment FROM mom")
def moments(spark, sf):
    return rounded(fitting.moment_fit(fitting.sufficient(counts(spark, sf), _expo(spark, sf))))


@register("d1_boundary_slopes", f"{STATS} SELECT dataset, feature, n_expr, round(sy2 - 2 * mu * sye + mu * mu * se2 - mu * se + mu * se2 / se, 5) AS slope0 FROM ss")
def slopes(spark, sf):
    return rounded(fitting.sufficient(counts(spark, sf), _expo(spark, sf)).select("dataset", "feature", "n_expr", "slope0"), 5)


@register("d5_fit_table")
def fit_table(spark, sf):
    fits = fitting.fit_dispersions(counts(spark, sf), _expo(spark, sf))
    return rounded(fits.withColumn("theta", F.when(F.col("theta") < float("inf"), F.col("theta"))), 4)


@register("d8_class_tally")
def tally(spark, sf):
    return fitting.class_tally(fitting.fit_dispersions(counts(spark, sf), _expo(spark, sf)))


@register("d14_allele_components", f"""{STATS}, {SHARE.split('units AS')[1].split('GROUP BY ALL)', 1)[1].lstrip(', ')},
tt AS (SELECT *, var_c / (cbar * cbar) AS r_c, var_c / ((1 - cbar) * (1 - cbar)) AS r_e FROM terms),
o AS (SELECT unit, any_value(expo) AS o FROM expo WHERE dataset LIKE 'HYB%' GROUP BY unit),
w AS (SELECT feature, unit, sum(CASE WHEN dataset = 'HYB.SC' THEN y ELSE 0 END) AS yc, sum(CASE WHEN dataset = 'HYB.SE' THEN y ELSE 0 END) AS ye FROM counts WHERE dataset LIKE 'HYB%' GROUP BY ALL),
g AS (SELECT feature, sum(yc) AS c, sum(ye) AS e, sum(yc * ye / (o * o)) AS ce, sum(yc * yc / (o * o)) AS cc, sum(ye * ye / (o * o)) AS ee, sum(yc / (o * o)) AS c1, sum(ye / (o * o)) AS e1 FROM w JOIN o USING (unit) GROUP BY feature),
h AS (SELECT g.*, n, c / so AS mc, e / so AS me, tt.* FROM g, (SELECT count(*) AS n, sum(o) AS so FROM o), tt WHERE c > 0 AND e > 0),
i AS (SELECT *, ce / (mc * me) / n AS both_, (r_c + r_e) / 2 AS eta, sqrt(r_c * r_e) AS cross_, (cc / (mc * mc) + ee / (me * me)) / n AS sq, (c1 / (mc * mc) + e1 / (me * me)) / n / 2 AS shot FROM h),
j AS (SELECT *, both_ / (1 - cross_) - 1 AS d FROM i),
k AS (SELECT *, greatest(d, 0) AS sd, greatest((0.5 * (sq - 2 * both_) - shot - (eta + cross_) * (1 + d)) / (1 + eta), 0) AS sq_, c / (c + e) AS pi FROM j),
l AS (SELECT *, pi * pi + (1 - pi) * (1 - pi) AS wsq FROM k)
SELECT feature, round(pi, 6) AS pi, round(sd, 6) AS sigma_d, round(sq_, 6) AS sigma_q, CASE WHEN sd + sq_ > 0 THEN round(log2((sd + sq_) / (sd + wsq * sq_)), 6) ELSE 0.0 END AS delta, round((1 - wsq) * sq_, 6) AS delta_raw,
round(var_c * ((1 + sd) * pow(pi / cbar - (1 - pi) / (1 - cbar), 2) + sq_ * (pi * pi / (cbar * cbar) + (1 - pi) * (1 - pi) / ((1 - cbar) * (1 - cbar)))), 6) AS share_sub FROM l""")
def components(spark, sf):
    return rounded(fitting.allele_components(counts(spark, sf), _expo(spark, sf), offsets.share_terms(_pairs(spark, sf))))


_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{d}' AS dataset, CAST({w} AS DOUBLE) AS weight, {len(g)} AS k" for m, g in contrasts.MODE_GROUPS.items() if m in ("total", "mid", "par_sc", "par_se") for d, w in g.items())


@register("c6_contrasts", f"""{STATS}, mg AS ({_MODES}), f AS (SELECT dataset, feature, mu, CASE WHEN disp_moment > 0 THEN disp_moment ELSE 0.0 END AS disp FROM mom),
g AS (SELECT feature, mode, any_value(k) AS k, count(mu) AS nm, sum(weight * log2(mu)) AS gm, sum(CASE WHEN weight > 0 THEN weight * mu END) AS up, sum(CASE WHEN weight < 0 THEN -weight * mu END) AS down,
  sum(CASE WHEN disp > 0 THEN weight * log2(CASE WHEN disp > 0 THEN disp END) END) AS d, count(CASE WHEN disp > 0 THEN 1 END) AS nd, sum(weight * disp) AS r, sum(weight * log2(disp + 1 / mu)) AS c FROM f JOIN mg USING (dataset) GROUP BY ALL)
SELECT feature, mode, round(CASE WHEN nm = k THEN CASE WHEN mode = 'total' THEN gm ELSE log2(up) - log2(down) END END, 6) AS mean, round(CASE WHEN nd = k THEN d END, 6) AS disp,
round(CASE WHEN nm = k THEN r END, 6) AS raw, round(CASE WHEN nm = k THEN c END, 6) AS cv2 FROM g""")
def all_contrasts(spark, sf):
    fits = fitting.moment_fit(fitting.sufficient(counts(spark, sf), _expo(spark, sf)))
    fits = fits.select("dataset", "feature", "mu", F.greatest("disp_moment", F.lit(0.0)).alias("disp"))
    modes = {m: contrasts.MODE_GROUPS[m] for m in ("total", "mid", "par_sc", "par_se")}
    return rounded(contrasts.contrasts(fits, contrasts.mode_groups(spark, modes)))


@register("x2_correlations")
def correlations(spark, sf):
    c, u = counts(spark, sf), _expo(spark, sf)
    fits = fitting.moment_fit(fitting.sufficient(c, u)).select("dataset", "feature", "mu", F.greatest("disp_moment", F.lit(0.0)).alias("disp"))
    return rounded(coexpression.shrunken_correlations(coexpression.pearson_residuals(c, u, fits), "MIX.SC"))


@register("d18_within_between", f"""{EXPO}, cl AS (SELECT dataset, unit, CAST(unit AS BIGINT) % 3 AS cluster FROM units),
m AS (SELECT cl.dataset, cl.unit, cluster, expo FROM cl JOIN expo e ON cl.dataset = e.dataset AND cl.unit = e.unit), s AS (SELECT dataset, cluster, count(*) AS nc FROM m GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT c.dataset, c.feature, m.cluster, sum(y / expo) AS s, sum((y / expo) * (y / expo)) AS q, sum(y / expo / expo) AS shot FROM counts c JOIN m ON c.dataset = m.dataset AND c.unit = m.unit GROUP BY ALL),
g AS (SELECT f.dataset, f.feature, s.cluster, nc, coalesce(p.s, 0) AS s, coalesce(p.q, 0) AS q, coalesce(p.shot, 0) AS shot FROM (SELECT DISTINCT dataset, feature FROM counts) f JOIN s ON f.dataset = s.dataset LEFT JOIN p ON p.dataset = f.dataset AND p.feature = f.feature AND p.cluster = s.cluster),
w AS (SELECT dataset, feature, sum(nc) AS n, sum(s) / sum(nc) AS m FROM g GROUP BY ALL),
v AS (SELECT g.*, n, m, s / nc AS mean, (q - s * s / nc) / (nc - 1) AS var FROM g JOIN w ON g.dataset = w.dataset AND g.feature = w.feature WHERE m > 0)
SELECT dataset, feature, round(sum(nc / n * (var - shot / nc) / (m * m)), 6) AS "within", round(sum(nc / n * ((mean - m) * (mean - m) - var / nc) / (m * m)), 6) AS "between" FROM v GROUP BY ALL""")
def noise_split(spark, sf):
    c, u = counts(spark, sf), _expo(spark, sf)
    return rounded(states.within_between(c, u, u.select("dataset", "unit", (F.col("unit").cast("long") % 3).alias("cluster"))))
