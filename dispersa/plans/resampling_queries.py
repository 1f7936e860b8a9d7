"""Queries on resampled fits: bound to customers as units, with depth-matched splits of the hybrid's units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.functions import stats
from dispersa.operators import bootstrap, classes, doublets, nulls, offsets, profiles, reports
from dispersa.plans.bindings import counts
from dispersa.plans.count_queries import EXPO, PAIRS, WITH, _expo, _pairs
from dispersa.plans.registry import register, rounded
from dispersa.session import read_table
from dispersa.sources.results import checkpointed

#: Shares of the hybrid's units on the C side of the mean, the noise and the balance split.
FRACTIONS = {"hyc": 0.4, "hyc_n": 0.35, "hyc_k": 0.3}

_SPLITS = "".join(
    f""",
k_{c} AS (SELECT DISTINCT CAST(round_even(1 + j * CASE WHEN k > 1 THEN (n - 1) / (k - 1) ELSE 0 END, 0) AS BIGINT) AS r FROM (SELECT n, k, unnest(range(k)) AS j FROM (SELECT count(*) AS n, CAST(round_even({f} * count(*), 0) AS BIGINT) AS k FROM o)))"""
    for c, f in FRACTIONS.items()
)
STRATA = EXPO + """,
o AS (SELECT unit, row_number() OVER (ORDER BY s DESC, unit) AS r FROM hyb)""" + _SPLITS + """,
st AS (SELECT unit, 2 + CASE WHEN r IN (SELECT r FROM k_hyc) THEN 0 ELSE 1 END + CASE WHEN r IN (SELECT r FROM k_hyc_n) THEN 0 ELSE 2 END + CASE WHEN r IN (SELECT r FROM k_hyc_k) THEN 0 ELSE 4 END AS stratum FROM o
  UNION ALL SELECT unit, CASE dataset WHEN 'MIX.SC' THEN 0 ELSE 1 END FROM units WHERE dataset LIKE 'MIX%')"""


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """(unit, hyc, hyc_n, hyc_k) of the hybrid's units."""
    ranked = offsets.depth_order(_pairs(spark, sf).select(F.lit("HYB").alias("dataset"), "unit", (F.col("a") + F.col("b")).alias("lib")))
    out = ranked.select("unit")
    for name, fraction in FRACTIONS.items():
        out = out.join(offsets.depth_split(ranked, fraction).select("unit", (F.col("side") == "c").alias(name)), "unit")
    return out


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """(unit, chat, lib): share of the first allele and total of both."""
    lib = F.col("a") + F.col("b")
    return _pairs(spark, sf).where(lib > 0).select("unit", (F.col("a") / lib).alias("chat"), lib.alias("lib"))


def _finite(df: DataFrame, *names: str) -> DataFrame:
    """Infinite values as null, with a flag of their sign beside them."""
    for c in names:
        df = df.withColumn(f"{c}_inf", F.when(F.abs(c) == float("inf"), F.signum(c).cast("int"))).withColumn(c, F.when(F.abs(c) < float("inf"), F.col(c)))
    return df


#: Draws of the bootstrap queries.
DRAWS = bootstrap.DRAWS


def _drawn(spark, sf):
    placed = checkpointed(bootstrap.stratified_units(_expo(spark, sf), splits(spark, sf)))
    return bootstrap.hashed_refits(counts(spark, sf), placed, DRAWS, 1), bootstrap.hashed_shares(placed, shares(spark, sf), DRAWS, 1)


@register("i1_stratified_draws", f"""{STRATA}, d AS (SELECT unnest(range(0, 51)) AS draw)
SELECT CAST(draw AS INT) AS draw, stratum, count(*) AS n_units, CAST(count(*) AS BIGINT) AS drawn, count(*) AS checked FROM st, d GROUP BY ALL""")
def stratified(spark, sf):
    """Sizes of all strata in 51 draws: the number of units drawn equals the stratum's, and no position is outside it."""
    placed = bootstrap.stratified_units(_expo(spark, sf), splits(spark, sf))
    weights = bootstrap.unit_draws(placed, 50, 1)
    sizes = placed.groupBy("stratum").agg(F.count("*").alias("n_units"), F.count_if(F.col("pos").between(0, F.col("n") - 1)).alias("checked"))
    return weights.groupBy("draw", "stratum").agg(F.sum("w").alias("drawn")).join(sizes, "stratum").select("draw", "stratum", "n_units", "drawn", "checked")


@register("i2_coexpression_draws", f"""{EXPO}, g AS (SELECT CASE dataset WHEN 'MIX.SC' THEN 0 ELSE 1 END AS stratum, count(*) AS n FROM units WHERE dataset LIKE 'MIX%' GROUP BY ALL UNION ALL SELECT 9, count(*) FROM hyb)
SELECT CAST(draw AS INT) AS draw, CAST(stratum AS INT) AS stratum, CAST(n AS BIGINT) AS drawn FROM g, (SELECT unnest(range(0, 51)) AS draw)""")
def coexpression(spark, sf):
    weights = bootstrap.unit_draws(bootstrap.coexpression_units(_expo(spark, sf)), 50, 2)
    return weights.groupBy("draw", "stratum").agg(F.sum("w").alias("drawn"))


@register("i5_contrast_bootstrap")
def contrast_bootstrap(spark, sf):
    refits, terms = _drawn(spark, sf)
    return rounded(_finite(bootstrap.bootstrap_summary(bootstrap.draw_contrasts(refits, terms)), "est", "se", "lo", "hi"), 4)


@register("i4_pilot_errors")
def pilot_errors(spark, sf):
    refits, terms = _drawn(spark, sf)
    return rounded(bootstrap.pilot_errors(refits, terms), 4)


def _null_inputs(spark, sf):
    units = _expo(spark, sf)
    hyc = splits(spark, sf).where("hyc").select("unit")
    cbar = shares(spark, sf).where("lib > 1").agg(F.avg("chat")).first()[0]
    items, cells = checkpointed(nulls.pooled_items(units, hyc)), checkpointed(nulls.pooled_cells(counts(spark, sf), hyc, cbar))
    return items, cells, cbar


def _mean_nulls(spark, sf, draws, label=None, shift=52):
    items, cells, cbar = _null_inputs(spark, sf)
    labelled = nulls.labelled_items(checkpointed(nulls.with_cells(items, cells)), draws, 3, label, shift)
    return nulls.labelled_mean_nulls(labelled, _levels(items, cells, cbar), cbar)


def _levels(items, cells, cbar) -> dict[str, float]:
    """A number a feature: the hybrid's mean rate in the trans set over the parents', geometric means of both alleles."""
    wanted = ["trans_sc", "trans_se"]
    side = F.substring("item", 1, 1).cast("int").alias("side")
    down = items.where(F.col("pool").isin(wanted)).groupBy("pool", "side").agg(F.sum("expo").alias("e"))
    up = cells.where(F.col("pool").isin(wanted)).groupBy("feature", "pool", side).agg(F.sum("y").alias("y"))
    log = F.log(F.col("y") / F.col("e") / F.when(F.col("side") == 0, 1.0).when(F.col("pool") == "trans_sc", 2 * cbar).otherwise(2 * (1 - cbar)))
    s = up.join(down, ["pool", "side"]).groupBy("feature").agg(F.exp(F.sum(F.when(F.col("side") == 1, log).otherwise(-log)) / 2).alias("k"), F.count("*").alias("n"))
    return {r.feature: r.k for r in s.where("n = 4").collect()}


#: Relabellings of the registered queries; the library takes any number.
RELABELLINGS = 1000


@register("i9_mean_nulls")
def mean_nulls(spark, sf):
    items, cells, cbar = _null_inputs(spark, sf)
    values = checkpointed(nulls.hashed_mean_nulls(items, cells, RELABELLINGS, 3, _levels(items, cells, cbar), cbar))
    return rounded(nulls.null_p(values, ["value"]).drop("quantity"))


@register("i12_refit_nulls")
def refit_nulls(spark, sf):
    items, cells, _ = _null_inputs(spark, sf)
    terms = offsets.share_terms(_pairs(spark, sf)).first()
    got = nulls.null_p(nulls.fit_nulls(checkpointed(nulls.hashed_half_fits(items, cells, RELABELLINGS, 3)), terms.r_c, terms.r_e), ["mu", "disp", "cv2", "rdisp"])
    return rounded(_finite(got, "obs"), 4)


def _arithmetic(pool, draw, name):
    return (draw * 7919 + F.regexp_replace(name, ":", "").cast("long") * 104729 + F.length(pool) * 31) % 1000003


_H = "(draw * 7919 + CAST(replace({0}, ':', '') AS BIGINT) * 104729 + length(pool) * 31) % 1000003"
_PARENT = "SELECT '{0}' AS pool, '{1}:' || unit AS item, unit, {1} AS side, expo AS e FROM expo WHERE dataset = '{2}'"
_HYBRID = "SELECT '{0}', '{1}:' || unit, unit, {1}, {2} * e FROM he WHERE {3}"
_COUNTED = "SELECT '{0}' AS pool, '{1}:' || unit AS item, feature, CAST(y AS DOUBLE) AS z FROM counts WHERE dataset = '{2}'"
_ALLELE = "SELECT '{0}', '{1}:' || unit, feature, {2} FROM counts JOIN he USING (unit), cb WHERE dataset = '{3}' AND {4}"
CHAIN = f"""{STRATA}{PAIRS[len(WITH):]}, cb AS (SELECT avg(a / (a + b)) AS c FROM pairs WHERE a + b > 1),
he AS (SELECT unit, max(expo) AS e, any_value(r IN (SELECT r FROM k_hyc)) AS cis FROM expo JOIN o USING (unit) WHERE dataset LIKE 'HYB%' GROUP BY unit),
it AS ({_PARENT.format('total', 0, 'MIX.SC')} UNION ALL {_PARENT.format('total', 1, 'MIX.SE')} UNION ALL {_PARENT.format('trans_sc', 0, 'MIX.SC')} UNION ALL {_PARENT.format('trans_se', 0, 'MIX.SE')}
  UNION ALL {_PARENT.format('par_sc', 1, 'MIX.SC')} UNION ALL {_PARENT.format('par_se', 1, 'MIX.SE')} UNION ALL {_HYBRID.format('trans_sc', 1, 1, 'NOT cis')} UNION ALL {_HYBRID.format('trans_se', 1, 1, 'NOT cis')}
  UNION ALL {_HYBRID.format('par_sc', 0, 2, 'true')} UNION ALL {_HYBRID.format('par_se', 0, 2, 'true')} UNION ALL {_HYBRID.format('cis', 0, 1, 'cis')} UNION ALL {_HYBRID.format('cis', 1, 1, 'cis')}),
both_ AS (SELECT feature, unit, sum(CASE dataset WHEN 'HYB.SC' THEN y / (2 * c) ELSE y / (2 * (1 - c)) END) AS z FROM counts, cb WHERE dataset LIKE 'HYB%' GROUP BY ALL),
cz AS ({_COUNTED.format('total', 0, 'MIX.SC')} UNION ALL {_COUNTED.format('total', 1, 'MIX.SE')} UNION ALL {_COUNTED.format('trans_sc', 0, 'MIX.SC')} UNION ALL {_COUNTED.format('trans_se', 0, 'MIX.SE')}
  UNION ALL {_COUNTED.format('par_sc', 1, 'MIX.SC')} UNION ALL {_COUNTED.format('par_se', 1, 'MIX.SE')} UNION ALL {_ALLELE.format('trans_sc', 1, 'y', 'HYB.SC', 'NOT cis')} UNION ALL {_ALLELE.format('trans_se', 1, 'y', 'HYB.SE', 'NOT cis')}
  UNION ALL {_ALLELE.format('cis', 0, 'y / (2 * c)', 'HYB.SC', 'cis')} UNION ALL {_ALLELE.format('cis', 1, 'y / (2 * (1 - c))', 'HYB.SE', 'cis')}
  UNION ALL SELECT 'par_sc', '0:' || unit, feature, z FROM both_ UNION ALL SELECT 'par_se', '0:' || unit, feature, z FROM both_),
n0 AS (SELECT pool, count(*) AS n FROM it WHERE side = 0 GROUP BY pool),
lab AS (SELECT it.*, draw, CASE WHEN draw = 0 THEN side = 0 WHEN pool = 'cis' THEN side = ({_H.format('unit')}) % 2 ELSE row_number() OVER (PARTITION BY pool, draw ORDER BY {_H.format('item')}, item) <= n END AS half FROM it JOIN n0 USING (pool), (SELECT unnest(range(51)) AS draw)),
of_ AS (SELECT pool, draw, half, coalesce(sum(e) FILTER (side = 0), 0) AS e0, coalesce(sum(e) FILTER (side = 1), 0) AS e1 FROM lab GROUP BY ALL),
ys AS (SELECT pool, draw, half, feature, sum(z) AS s FROM cz JOIN lab USING (pool, item) GROUP BY ALL),
ms AS (SELECT pool, CAST(item[1] AS INT) AS side, feature, sum(z) AS s FROM cz WHERE pool LIKE 'trans%' GROUP BY ALL), me AS (SELECT pool, side, sum(e) AS e FROM it GROUP BY ALL),
kk AS (SELECT feature, exp(sum(CASE side WHEN 1 THEN ln(s / e / (CASE pool WHEN 'trans_sc' THEN 2 * c ELSE 2 * (1 - c) END)) ELSE -ln(s / e) END) / 2) AS k FROM ms JOIN me USING (pool, side), cb GROUP BY feature HAVING count(*) = 4),
lv AS (SELECT pool, draw, half, feature, log2(s / (e0 + e1 * CASE pool WHEN 'trans_sc' THEN k * 2 * c WHEN 'trans_se' THEN k * 2 * (1 - c) ELSE 1 END)) AS l FROM ys JOIN of_ USING (pool, draw, half) LEFT JOIN kk USING (feature), cb),
ap AS (SELECT pool, draw, feature, max(l) FILTER (half) - max(l) FILTER (NOT half) AS v FROM lv GROUP BY ALL),
va AS (SELECT pool AS mode, draw, feature, v FROM ap WHERE pool NOT LIKE 'trans%' UNION ALL SELECT 'trans', draw, feature, x.v - z.v FROM (SELECT * FROM ap WHERE pool = 'trans_sc') x JOIN (SELECT * FROM ap WHERE pool = 'trans_se') z USING (draw, feature)),
pv AS (SELECT mode, feature, any_value(b.v) AS est, (1 + count(*) FILTER (abs(va.v) >= abs(b.v)))::DOUBLE / (1 + count(va.v)) AS p FROM va JOIN (SELECT mode, feature, v FROM va WHERE draw = 0 AND v IS NOT NULL) b USING (mode, feature) WHERE draw > 0 GROUP BY ALL),
rk AS (SELECT *, count(*) OVER (PARTITION BY mode) AS m, count(*) OVER (PARTITION BY mode ORDER BY p) AS r FROM pv),
qv AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY mode ORDER BY p DESC)) AS q FROM rk),
wd AS (SELECT feature, {', '.join(f"max(est) FILTER (mode = '{m}') AS est_{m}, max(q) FILTER (mode = '{m}') AS q_{m}" for m in ('cis', 'trans', 'par_sc', 'par_se'))} FROM qv GROUP BY feature)"""


@register("k1_tested_classes", f"""{CHAIN}
SELECT feature, {', '.join(f'round(est_{m}, 6) AS est_{m}, round(q_{m}, 6) AS q_{m}' for m in ('cis', 'trans', 'par_sc', 'par_se'))},
CASE WHEN q_cis IS NULL OR q_trans IS NULL THEN NULL WHEN q_cis >= 0.5 AND q_trans >= 0.5 THEN 'Conserved' WHEN q_cis < 0.5 AND q_trans >= 0.5 THEN 'Cis' WHEN q_cis >= 0.5 AND q_trans < 0.5 THEN 'Trans' WHEN sign(est_cis * est_trans) >= 0 THEN 'Cis + Trans' ELSE 'Compensatory' END AS reg,
CASE WHEN q_par_sc IS NULL OR q_par_se IS NULL THEN NULL WHEN q_par_sc >= 0.5 AND q_par_se >= 0.5 THEN 'Conserved' WHEN q_par_sc < 0.5 AND q_par_se >= 0.5 THEN 'Se.Dominant' WHEN q_par_sc >= 0.5 AND q_par_se < 0.5 THEN 'Sc.Dominant' WHEN sign(sign(est_par_sc) + sign(est_par_se)) > 0 THEN 'Overdominant' WHEN sign(sign(est_par_sc) + sign(est_par_se)) < 0 THEN 'Underdominant' ELSE 'Additive' END AS dom
FROM wd""")
def tested_classes(spark, sf):
    """From counts to classes: relabelled means, p, q and both classifications; labels by arithmetic, so that SQL has the same."""
    p = nulls.null_p(_mean_nulls(spark, sf, 50, _arithmetic, 8), ["value"])  # hashes below 1,000,003 have about 3,900 buckets
    q = stats.benjamini_hochberg(p.where("p IS NOT NULL").select("feature", "mode", F.col("obs").alias("est"), "p"), "p", ["mode"])
    of = lambda c, m: F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_{m}")
    wide = q.groupBy("feature").agg(*[of(c, m) for m in ("cis", "trans", "par_sc", "par_se") for c in ("est", "q")])
    col = lambda *names: [F.col(n) for n in names]
    reg = classes.regulatory_class(*col("q_cis", "q_trans", "est_cis", "est_trans"), sig=0.5)
    dom = classes.dominance_class(*col("q_par_sc", "q_par_se", "est_par_sc", "est_par_se"), sig=0.5)
    return rounded(wide.withColumn("reg", reg).withColumn("dom", dom))


@register("q13_doublet_scores")
def doublet_scores(spark, sf):
    """Scores of all units of all datasets, each dataset among its own simulated sums."""
    c, out = checkpointed(counts(spark, sf)), None
    for name in ("MIX.SC", "MIX.SE", "HYB.SC", "HYB.SE"):
        got = doublets.doublet_scores(c.where(F.col("dataset") == name)).withColumn("dataset", F.lit(name))
        out = got if out is None else out.union(got)
    return rounded(out)


@register("d20_paired_profiles", f"""{EXPO}, he AS (SELECT unit, max(expo) AS e FROM expo WHERE dataset LIKE 'HYB%' GROUP BY unit),
mu AS (SELECT feature, dataset, sum(y) / (SELECT sum(e) FROM he) AS mu FROM counts WHERE dataset LIKE 'HYB%' GROUP BY ALL),
cl AS (SELECT m.feature, m.dataset, mu * e AS m, coalesce(y, 0) AS y, count(*) AS n FROM mu m CROSS JOIN he LEFT JOIN counts c ON c.feature = m.feature AND c.dataset = m.dataset AND c.unit = he.unit GROUP BY ALL),
gr AS (SELECT CAST(k AS INT) AS k, exp(-4 + 0.1 * k) AS t FROM (SELECT unnest(range(191)) AS k)),
lk AS (SELECT feature, dataset, k, sum(n * (lgamma(y + t) - lgamma(t) + t * ln(t) - (t + y) * ln(t + m) + y * ln(m))) AS l FROM cl, gr GROUP BY ALL),
sh AS (SELECT a.feature, b.k - a.k AS d, max(a.l + b.l) AS m FROM (SELECT * FROM lk WHERE dataset = 'HYB.SC') a JOIN (SELECT * FROM lk WHERE dataset = 'HYB.SE') b USING (feature) GROUP BY ALL),
tp AS (SELECT feature, max(m) AS top, arg_max(d, m) AS j FROM sh GROUP BY feature), dv AS (SELECT sh.feature, d, 2 * (top - m) AS dev, j FROM sh JOIN tp USING (feature)),
ed AS (SELECT feature, max(d) FILTER (d < j AND dev > 3.841458820694124) AS l, min(d) FILTER (d > j AND dev > 3.841458820694124) AS r FROM dv GROUP BY feature),
en AS (SELECT ed.feature, l + 1 - (3.841458820694124 - b.dev) / (a.dev - b.dev) AS lo, r - 1 + (3.841458820694124 - c.dev) / (d.dev - c.dev) AS hi FROM ed LEFT JOIN dv a ON a.feature = ed.feature AND a.d = l LEFT JOIN dv b ON b.feature = ed.feature AND b.d = l + 1
  LEFT JOIN dv c ON c.feature = ed.feature AND c.d = r - 1 LEFT JOIN dv d ON d.feature = ed.feature AND d.d = r)
SELECT feature, CASE WHEN abs(lo * 0.1 / ln(2)) <= 10 THEN round(lo * 0.1 / ln(2), 3) END AS lo, CASE WHEN abs(hi * 0.1 / ln(2)) <= 10 THEN round(hi * 0.1 / ln(2), 3) END AS hi FROM en""")
def paired_profiles(spark, sf):
    """Ends of the intervals, open ones as null; a flat profile's peak depends on rounding, so it isn't compared."""
    units = _expo(spark, sf).where(F.col("dataset").startswith("HYB.")).groupBy("unit").agg(F.max("expo").alias("expo"))
    got = profiles.paired_profile(profiles.likelihood_grid(counts(spark, sf), units))
    return rounded(got.select("feature", *[F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("lo", "hi")]), 3)


@register("k9_tukey_pairs")
def tukey_pairs(spark, sf):
    """Pairs of part types by price, where the types differ at all; the level is wide, as these prices hardly differ."""
    return rounded(reports.tukey_pairs(read_table(spark, sf, "part"), "p_retailprice", "p_type", sig=1.0))
