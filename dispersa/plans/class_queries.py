"""Queries on tests, classes, resampling and enrichment, bound to parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.functions import stats
from dispersa.operators import agreement, axes, classes, enrichment, resampling, states
from dispersa.plans.bindings import COUNTS_SQL, counts
from dispersa.plans.registry import register, rounded
from dispersa.session import read_table

WITH = "WITH " + COUNTS_SQL.strip()
#: Deterministic p-values and effects of parts, in place of tests.
PARTS_SQL = """WITH pv AS (SELECT p_partkey, p_type AS family, CAST((p_partkey * 7919) % 10007 + 1 AS DOUBLE) / 10008.0 AS p, CAST((p_partkey * 104729) % 10007 + 1 AS DOUBLE) / 10008.0 AS p2,
  CAST((p_partkey * 31) % 2001 - 1000 AS DOUBLE) / 500.0 AS est, CAST((p_partkey * 57) % 2001 - 1000 AS DOUBLE) / 500.0 AS est2 FROM part)"""


def part_tests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return read_table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("family"), ((k * 7919 % 10007 + 1) / 10008.0).alias("p"), ((k * 104729 % 10007 + 1) / 10008.0).alias("p2"),
        ((k * 31 % 2001 - 1000) / 500.0).alias("est"), ((k * 57 % 2001 - 1000) / 500.0).alias("est2"),
    )


@register("i14_bh", f"""{PARTS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY p) AS lo, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p) AS r FROM pv),
q AS (SELECT p_partkey, family, p, least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY p DESC)) AS q FROM r) SELECT p_partkey, family, round(p, 6) AS p, round(q, 6) AS q FROM q""")
def bh(spark, sf):
    return rounded(stats.benjamini_hochberg(part_tests(spark, sf).select("p_partkey", "family", "p"), "p", ["family"]))


_REG = """CASE WHEN p >= 0.3 AND p2 >= 0.3 THEN 'Conserved' WHEN p < 0.3 AND p2 >= 0.3 THEN 'Cis' WHEN p >= 0.3 AND p2 < 0.3 THEN 'Trans' WHEN sign(est * est2) >= 0 THEN 'Cis + Trans' ELSE 'Compensatory' END"""
_DOM = """CASE WHEN p >= 0.3 AND p2 >= 0.3 THEN 'Conserved' WHEN p < 0.3 AND p2 >= 0.3 THEN 'Se.Dominant' WHEN p >= 0.3 AND p2 < 0.3 THEN 'Sc.Dominant' WHEN sign(sign(est) + sign(est2)) > 0 THEN 'Overdominant' WHEN sign(sign(est) + sign(est2)) < 0 THEN 'Underdominant' ELSE 'Additive' END"""


def _classed(spark, sf):
    t = part_tests(spark, sf)
    c = [F.col(x) for x in ("p", "p2", "est", "est2")]
    return t.withColumn("reg", classes.regulatory_class(*c, sig=0.3)).withColumn("dom", classes.dominance_class(*c, sig=0.3))


CLASSED = f"{PARTS_SQL}, cl AS (SELECT *, {_REG} AS reg, {_DOM} AS dom FROM pv)"


@register("k1_classes", f"{CLASSED} SELECT p_partkey, reg, dom FROM cl")
def classed(spark, sf):
    return _classed(spark, sf).select("p_partkey", "reg", "dom")


@register("k4_level_counts", f"""{CLASSED}, lv AS (SELECT unnest(['Conserved', 'Cis', 'Trans', 'Cis + Trans', 'Compensatory']) AS level, unnest([0, 1, 2, 3, 4]) AS ord)
SELECT level, ord, count(reg) AS n FROM lv LEFT JOIN cl ON reg = level GROUP BY level, ord""")
def levels(spark, sf):
    return classes.level_counts(_classed(spark, sf), "reg", list(classes.REGULATORY))


@register("k5_overlap", f"""{CLASSED}, r AS (SELECT reg AS a, dom AS b, count(*) AS obs FROM cl GROUP BY ALL), na AS (SELECT a, sum(obs) AS na FROM r GROUP BY a), nb AS (SELECT b, sum(obs) AS nb FROM r GROUP BY b), t AS (SELECT sum(obs) AS n FROM r),
g AS (SELECT na.a, nb.b, coalesce(obs, 0) AS obs, na, nb, n, na * nb / n AS exp FROM na CROSS JOIN nb CROSS JOIN t LEFT JOIN r ON r.a = na.a AND r.b = nb.b),
x AS (SELECT *, unnest(range(CAST(greatest(0, na + nb - n) AS BIGINT), CAST(least(na, nb) + 1 AS BIGINT))) AS x FROM g),
m AS (SELECT *, exp_(lgamma(na + 1) + lgamma(n - na + 1) + lgamma(nb + 1) + lgamma(n - nb + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(na - x + 1) - lgamma(nb - x + 1) - lgamma(n - na - nb + x + 1)) AS pmf FROM x)
SELECT a, b, CAST(obs AS BIGINT) AS obs, round(any_value(exp), 6) AS exp, round(log2((obs + 0.5) / (any_value(exp) + 0.5)), 6) AS lor, round(least(1.0, 2 * least(sum(CASE WHEN x >= obs THEN pmf ELSE 0 END), sum(CASE WHEN x <= obs THEN pmf ELSE 0 END))), 6) AS p FROM m GROUP BY a, b, obs""".replace("exp_(", "exp("))
def overlap(spark, sf):
    return rounded(classes.overlap_table(_classed(spark, sf), "reg", "dom"))


@register("k7_agreement", f"""{CLASSED}, t AS (SELECT count(*) AS n, count_if(reg = dom) AS same FROM cl), e AS (SELECT sum(x.c * y.c) AS s FROM (SELECT reg, count(*) AS c FROM cl GROUP BY reg) x JOIN (SELECT dom, count(*) AS c FROM cl GROUP BY dom) y ON reg = dom)
SELECT n, round(same / n, 6) AS concordance, round(s / n / n, 6) AS chance, round((same / n - s / n / n) / (1 - s / n / n), 6) AS kappa FROM t, e""")
def kappa(spark, sf):
    return rounded(classes.agreement(_classed(spark, sf), "reg", "dom"))


@register("k7_jaccard", f"""{CLASSED}, lv AS (SELECT reg AS level FROM cl UNION SELECT dom FROM cl) SELECT level, round(count_if(reg = level AND dom = level) / count_if(reg = level OR dom = level), 6) AS jaccard FROM lv CROSS JOIN cl GROUP BY level""")
def jaccard(spark, sf):
    return rounded(classes.jaccard_by_class(_classed(spark, sf), "reg", "dom"))


@register("k8_class_moments", "SELECT p_type AS class, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(var_samp(p_retailprice), 2) AS var FROM part GROUP BY p_type")
def moments(spark, sf):
    m = classes.class_moments(read_table(spark, sf, "part"), "p_retailprice", "p_type")
    return m.select("class", "n", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


@register("k9_anova", """WITH g AS (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
SELECT k, CAST(n AS BIGINT) AS n, round((b - s * s / n) / (k - 1) / ((q - b) / (n - k)), 6) AS f, round((b - s * s / n) / (q - s * s / n), 6) AS eta2 FROM t""")
def anova(spark, sf):
    return rounded(stats.one_way_anova(read_table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@register("k10_class_slopes", "SELECT p_type AS class, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part GROUP BY p_type")
def slopes(spark, sf):
    got = classes.class_slopes(read_table(spark, sf, "part"), "p_retailprice", "p_size", "p_type")
    return got.select("class", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@register("k11_outer_groups", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'low' WHEN c_acctbal >= b THEN 'high' ELSE 'average' END AS level FROM customer, q""")
def outer(spark, sf):
    return classes.outer_groups(read_table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "level")


@register("k12_directions", f"{PARTS_SQL} SELECT CASE WHEN p < 0.2 AND est > 0 THEN 'sig_pos' WHEN p < 0.2 AND est < 0 THEN 'sig_neg' ELSE 'ns' END AS direction, count(*) AS n FROM pv GROUP BY 1")
def directions(spark, sf):
    return classes.directions(part_tests(spark, sf), "est", "p", 0.2)


_RANKS = "rank() OVER ({0}ORDER BY {1}) + (count(*) OVER (PARTITION BY {2}{1}) - 1) / 2"


@register("t8_spearman", f"""WITH r AS (SELECT o_orderpriority AS g, {_RANKS.format('PARTITION BY o_orderpriority ', 'o_totalprice', 'o_orderpriority, ')} AS a, {_RANKS.format('PARTITION BY o_orderpriority ', 'o_custkey', 'o_orderpriority, ')} AS b FROM orders)
SELECT g, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY g""")
def rho(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", "o_custkey")
    return rounded(stats.spearman(o, "o_totalprice", "o_custkey", ["g"]))


@register("t10_rank_sum", f"""WITH r AS (SELECT c_mktsegment AS g, c_nationkey < 10 AS one, {_RANKS.format('PARTITION BY c_mktsegment ', 'x', 'c_mktsegment, ')} AS r, count(*) OVER (PARTITION BY c_mktsegment, x) AS t FROM (SELECT *, round(c_acctbal / 100) AS x FROM customer)),
s AS (SELECT g, CAST(count_if(one) AS BIGINT) AS n1, CAST(count_if(NOT one) AS BIGINT) AS n2, sum(CASE WHEN one THEN r END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY g), u AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
SELECT g, n1, n2, u, round((u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def ranksum(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), "c_nationkey", F.round(F.col("c_acctbal") / 100).alias("x"))
    return rounded(stats.rank_sum(c, "x", F.col("c_nationkey") < 10, ["g"]))


@register("t11_kruskal_wallis", f"""WITH x AS (SELECT c_mktsegment AS g, c_nationkey AS k, round(c_acctbal / 100) AS x FROM customer), r AS (SELECT *, {_RANKS.format('PARTITION BY g ', 'x', 'g, ')} AS r, count(*) OVER (PARTITION BY g, x) AS t FROM x),
p AS (SELECT g, k, count(*) AS n, sum(r) AS s FROM r GROUP BY ALL), b AS (SELECT g, sum(n) AS n, sum(s * s / n) AS b FROM p GROUP BY g), ti AS (SELECT g, sum(t * t - 1) AS ties FROM r GROUP BY g)
SELECT g, round((12 / (CAST(n AS DOUBLE) * (n + 1)) * b - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)), 6) AS h FROM b JOIN ti USING (g)""")
def kruskal(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k"), F.round(F.col("c_acctbal") / 100).alias("x"))
    return rounded(stats.kruskal_wallis(c, "x", "k", ["g"]))


@register("l14_cohens_d", """WITH g AS (SELECT avg(c_acctbal) FILTER (c_nationkey < 10) AS m1, avg(c_acctbal) FILTER (c_nationkey >= 10) AS m2, var_samp(c_acctbal) FILTER (c_nationkey < 10) AS v1, var_samp(c_acctbal) FILTER (c_nationkey >= 10) AS v2,
count_if(c_nationkey < 10) AS n1, count_if(c_nationkey >= 10) AS n2 FROM customer) SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM g""")
def cohen(spark, sf):
    return rounded(states.cohens_d(read_table(spark, sf, "customer"), "c_acctbal", F.col("c_nationkey") < 10))


def _pick(seed, draw, slot, n):
    return (draw * 7919 + slot * 104729 + seed) % n


_DRAWS = f"""{WITH}, u AS (SELECT unit, lib, row_number() OVER (ORDER BY unit) - 1 AS pos, count(*) OVER () AS n FROM units WHERE dataset = 'MIX.SC'),
dr AS (SELECT d AS draw, (d * 7919 + s * 104729 + 11) % n AS pos FROM (SELECT unnest(range(1, 21)) AS d), (SELECT pos AS s, n FROM u)),
w AS (SELECT draw, pos, count(*) AS w FROM dr GROUP BY ALL)"""


def _weights(spark, sf):
    u = counts(spark, sf).where("dataset = 'MIX.SC'").groupBy("dataset", "unit").agg(F.sum("y").alias("lib"))
    placed = resampling.positions(u, "dataset", "unit")
    strata = placed.groupBy("stratum").agg(F.count("*").alias("n"))
    return u, placed, resampling.bootstrap_weights(strata, 20, 11, _pick)


@register("i1_bootstrap_weights", f"{_DRAWS} SELECT draw, pos, w FROM w")
def weights(spark, sf):
    return _weights(spark, sf)[2].select("draw", "pos", "w")


_MEANS = f"""{_DRAWS}, wu AS (SELECT draw, unit, w, lib FROM w JOIN u USING (pos)), e AS (SELECT draw, sum(w * lib) AS se FROM wu GROUP BY draw),
mu AS (SELECT draw, feature, sum(w * y) / any_value(se) AS mu FROM wu JOIN (SELECT * FROM counts WHERE dataset = 'MIX.SC') c USING (unit) JOIN e USING (draw) GROUP BY ALL)"""


def _means(spark, sf):
    u, placed, w = _weights(spark, sf)
    named = w.join(placed, ["stratum", "pos"]).select("draw", "unit", "w")
    return resampling.weighted_means(counts(spark, sf).where("dataset = 'MIX.SC'").drop("dataset"), u.select("unit", F.col("lib").alias("expo")), named)


@register("i5_bootstrap_means", f"{_MEANS} SELECT draw, feature, round(mu, 6) AS mu FROM mu")
def means(spark, sf):
    return rounded(_means(spark, sf))


@register("i6_draw_summary", f"{_MEANS} SELECT feature, round(quantile_disc(mu, 0.025), 6) AS lo, round(quantile_disc(mu, 0.975), 6) AS hi, round((quantile_disc(mu, 0.975) - quantile_disc(mu, 0.025)) / 3.92, 6) AS se, count(*) AS nfin, 0.0 AS infinite FROM mu GROUP BY feature")
def summary(spark, sf):
    return rounded(resampling.draw_summary(_means(spark, sf), ["feature"], "mu"))


_NULL = f"""{WITH}, pu AS (SELECT unit, sum(lib) AS expo, bool_or(dataset = 'MIX.SC') AS own FROM units WHERE dataset LIKE 'MIX%' GROUP BY unit), pc AS (SELECT feature, unit, sum(y) AS y FROM counts WHERE dataset LIKE 'MIX%' GROUP BY ALL),
lab AS (SELECT d AS draw, unit, CASE WHEN d = 0 THEN own ELSE (CAST(unit AS BIGINT) * 7919 + d * 104729) % 101 < 50 END AS one FROM pu, (SELECT unnest(range(0, 31)) AS d)),
e AS (SELECT draw, sum(expo) AS e1 FROM lab JOIN pu USING (unit) WHERE one GROUP BY draw), t AS (SELECT feature, sum(y) AS ty FROM pc GROUP BY feature), te AS (SELECT sum(expo) AS te FROM pu),
y AS (SELECT draw, feature, sum(y) AS y1 FROM lab JOIN pc USING (unit) WHERE one GROUP BY ALL),
v AS (SELECT e.draw, t.feature, log2((y1 / e1) / ((ty - y1) / (te - e1))) AS value FROM t CROSS JOIN e CROSS JOIN te JOIN y ON y.draw = e.draw AND y.feature = t.feature)"""


def _null(spark, sf):
    c = counts(spark, sf).where("dataset LIKE 'MIX%'")
    pooled = c.groupBy("unit").agg(F.sum("y").alias("expo"), F.bool_or(F.col("dataset") == "MIX.SC").alias("own"))
    d = F.col("draw")
    one = F.when(d == 0, F.col("own")).otherwise((F.col("unit").cast("long") * 7919 + d * 104729) % 101 < 50)
    labels = pooled.select("unit", "own", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("draw")).select("draw", "unit", F.when(one, 1).otherwise(2).alias("half"))
    return resampling.null_log2_ratio(c.groupBy("feature", "unit").agg(F.sum("y").alias("y")), pooled.select("unit", "expo"), labels)


@register("i9_null_ratios", f"{_NULL} SELECT draw, feature, round(value, 6) AS value FROM v")
def null(spark, sf):
    return rounded(_null(spark, sf))


@register("i13_permutation_p", f"{_NULL} SELECT o.feature, round(o.value, 6) AS obs, round((1 + count_if(abs(n.value) >= abs(o.value))) / (1 + count(n.value)), 6) AS p, count(n.value) AS n FROM v o JOIN v n ON o.feature = n.feature AND n.draw > 0 WHERE o.draw = 0 GROUP BY o.feature, o.value")
def permuted(spark, sf):
    v = _null(spark, sf)
    return rounded(resampling.permutation_p(v.where("draw = 0").select("feature", F.col("value").alias("obs")), v.where("draw > 0"), ["feature"]))


_CURVE = """WITH b AS (SELECT o_orderpriority AS k, CAST(floor(o_totalprice / 20000) AS BIGINT) + 1 AS ratio, count(*) AS c FROM orders GROUP BY ALL),
curve AS (SELECT k, ratio, sum(c) OVER (PARTITION BY k ORDER BY ratio) / sum(c) OVER (PARTITION BY k) AS power FROM b)"""


def _curve(spark, sf):
    from pyspark.sql import Window

    o = read_table(spark, sf, "orders")
    b = o.groupBy(F.col("o_orderpriority").alias("k"), (F.floor(F.col("o_totalprice") / 20000) + 1).alias("ratio")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("k")
    return b.withColumn("power", F.sum("c").over(w.orderBy("ratio")) / F.sum("c").over(w)).select("k", "ratio", "power")


@register("i22_detectable", f"""{_CURVE}, s AS (SELECT *, lag(ratio) OVER (PARTITION BY k ORDER BY ratio) AS x, lag(power) OVER (PARTITION BY k ORDER BY ratio) AS y FROM curve)
SELECT k, round(min_by(CASE WHEN x IS NULL OR y >= 0.8 THEN ratio ELSE 2 ** (log2(x) + (0.8 - y) * (log2(ratio) - log2(x)) / (power - y)) END, ratio), 6) AS ratio FROM s WHERE power >= 0.8 GROUP BY k""")
def detectable(spark, sf):
    return rounded(resampling.smallest_detectable(_curve(spark, sf), ["k"], 0.8))


@register("i23_crossing", f"""{_CURVE}, d AS (SELECT k, ratio AS x, power - 0.5 AS d FROM curve), s AS (SELECT *, lag(d) OVER (PARTITION BY k ORDER BY x) AS e, lag(x) OVER (PARTITION BY k ORDER BY x) AS w FROM d)
SELECT k, round(min_by(w + e / (e - d) * (x - w), x) FILTER (e IS NOT NULL AND sign(e) <> sign(d)), 6) AS "at" FROM s GROUP BY k""")
def crossing(spark, sf):
    return rounded(resampling.curve_crossing(_curve(spark, sf).withColumnRenamed("ratio", "x").withColumn("half", F.lit(0.5)), ["k"], "power", "half"))


@register("i16_seed_agreement")
def seeds(spark, sf):
    from dispersa.operators.offsets import exposures
    from dispersa.operators.qc import unit_totals

    c = counts(spark, sf)
    u = exposures(unit_totals(c)).where("dataset = 'MIX.SC'")
    placed = resampling.positions(u, "dataset", "unit")
    strata = placed.groupBy("stratum").agg(F.count("*").alias("n"))
    found = []
    for seed in (1, 2):
        w = resampling.bootstrap_weights(strata, 40, seed).join(placed, ["stratum", "pos"]).select("draw", "unit", "w")
        m = resampling.weighted_means(c.where("dataset = 'MIX.SC'").drop("dataset"), u.select("unit", "expo"), w)
        found.append(resampling.draw_summary(m, ["feature"], "mu"))
    return rounded(resampling.seed_agreement(found[0], found[1], ["feature"], "se"))


@register("i17_disattenuated", f"""{PARTS_SQL}, s AS (SELECT count(*) AS n, var_samp(est) AS vx, var_samp(est2) AS vy, covar_samp(est, est2) AS c, avg(p * p) AS ex, avg(p2 * p2) AS ey FROM pv)
SELECT n, round(vx - ex, 6) AS var_x, round(vy - ey, 6) AS var_y, round(c, 6) AS cov, round(c / sqrt(vx * vy), 6) AS raw, round(CASE WHEN vx > ex AND vy > ey THEN c / sqrt((vx - ex) * (vy - ey)) END, 6) AS corrected FROM s""")
def disattenuated(spark, sf):
    return rounded(resampling.disattenuated(part_tests(spark, sf), "est", "est2", "p", "p2"))


_SETS = """WITH t2f AS (SELECT DISTINCT s_nationkey AS term, l_partkey AS feature FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity < 10), uni AS (SELECT p_partkey AS feature FROM part),
sets AS (SELECT p_brand AS set_name, p_partkey AS feature FROM part)"""


def _sets(spark, sf):
    line, sup, part = (read_table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    t2f = line.where("l_quantity < 10").join(sup, line.l_suppkey == sup.s_suppkey).select(F.col("s_nationkey").alias("term"), F.col("l_partkey").alias("feature")).distinct()
    return part.select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("feature")), t2f, part.select(F.col("p_partkey").alias("feature"))


_ORA = """, m AS (SELECT term, count(*) AS m FROM t2f GROUP BY term HAVING count(*) BETWEEN 10 AND 500), k AS (SELECT set_name, count(*) AS k FROM sets GROUP BY set_name HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM uni),
h AS (SELECT set_name, term, count(*) AS x FROM sets JOIN t2f USING (feature) GROUP BY ALL), r AS (SELECT h.*, m, k, n FROM h JOIN m USING (term) JOIN k USING (set_name), n),
e AS (SELECT *, unnest(range(x, least(k, m) + 1)) AS j FROM r), p AS (SELECT set_name, term, x, m, k, least(1.0, sum(exp(lgamma(m + 1) + lgamma(n - m + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(j + 1) - lgamma(m - j + 1) - lgamma(k - j + 1) - lgamma(n - m - k + j + 1)))) AS p FROM e WHERE n - m - k + j >= 0 GROUP BY ALL),
q AS (SELECT *, count(*) OVER (PARTITION BY set_name) AS t, count(*) OVER (PARTITION BY set_name ORDER BY round(p, 9)) AS rk FROM p)
SELECT set_name, term, x AS overlap, m AS term_size, k AS set_size, round(p, 5) AS p, round(least(1.0, min(p * t / rk) OVER (PARTITION BY set_name ORDER BY p DESC)), 5) AS q FROM q"""


@register("g4_over_representation", _SETS + _ORA)
def ora(spark, sf):
    return rounded(enrichment.over_representation(*_sets(spark, sf)), 5)


_LEVELS = _SETS[: _SETS.index("sets AS")] + """sc AS (SELECT l_partkey AS feature, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS s FROM lineitem GROUP BY 1),
cut AS (SELECT quantile_cont(s, 0.25) AS a, quantile_cont(s, 0.75) AS b FROM sc), sets AS (SELECT 'finished_' || CASE WHEN s <= a THEN 'low' WHEN s >= b THEN 'high' ELSE 'average' END AS set_name, feature FROM sc, cut)"""


@register("g7_level_enrichment", _LEVELS + _ORA)
def levels(spark, sf):
    """Terms of parts whose share of finished line items is low, average or high."""
    _, t2f, universe = _sets(spark, sf)
    share = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg((F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("s"))
    return rounded(enrichment.over_representation(axes.level_sets(share, "feature", "s", "finished"), t2f, universe), 5)


@register("g5_running_sum")
def gsea(spark, sf):
    _, t2f, _ = _sets(spark, sf)
    ranks = read_table(spark, sf, "part").select(F.col("p_type").alias("list"), F.col("p_partkey").alias("feature"), (F.col("p_retailprice") / 1000).alias("score"))
    return rounded(enrichment.running_sum_score(ranks, t2f))


#: Random sets of the registered query; the library's default is a hundred times as many.
RANDOM_SETS = 1000


@register("g5_normalised_scores")
def normalised(spark, sf):
    _, t2f, _ = _sets(spark, sf)
    ranks = read_table(spark, sf, "part").select(F.col("p_type").alias("list"), F.col("p_partkey").alias("feature"), (F.col("p_retailprice") / 1000).alias("score"))
    return rounded(enrichment.normalised_scores(ranks, t2f, RANDOM_SETS))


@register("v4_pairwise_agreement", f"""WITH s AS (SELECT l_returnflag AS source, l_partkey AS feature, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), j AS (SELECT a.source AS source_a, b.source AS source_b, round(a.v, 9) AS x, round(b.v, 9) AS y FROM s a JOIN s b ON a.feature = b.feature AND a.source < b.source),
r AS (SELECT source_a, source_b, {_RANKS.format('PARTITION BY source_a, source_b ', 'x', 'source_a, source_b, ')} AS rx, {_RANKS.format('PARTITION BY source_a, source_b ', 'y', 'source_a, source_b, ')} AS ry FROM j)
SELECT source_a, source_b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL""")
def pairwise(spark, sf):
    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_quantity"), 9).alias("v"))
    return rounded(agreement.pairwise_agreement(s, "v"))


@register("v1_implied_terms", """WITH s AS (SELECT l_partkey AS feature, avg(l_quantity) AS mean, var_samp(l_quantity) / (avg(l_quantity) * avg(l_quantity)) AS cv2 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1)
SELECT feature, round(mean, 6) AS mean, round(cv2, 6) AS cv2, round(mean * cv2, 6) AS fano, round(mean * cv2 - 1, 6) AS bsize, round(cv2 - 1 / mean, 6) AS disp FROM s""")
def implied(spark, sf):
    m = F.avg("l_quantity")
    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(m.alias("mean"), (F.var_samp("l_quantity") / (m * m)).alias("cv2"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rounded(agreement.implied_terms(s))


@register("j9_mutual_best", """WITH p AS (SELECT s_nationkey AS a, l_partkey % 50 AS b, count(*) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a DESC) AS rb FROM p) SELECT a, b, score FROM x WHERE ra = 1 AND rb = 1""")
def mutual(spark, sf):
    line, sup = read_table(spark, sf, "lineitem"), read_table(spark, sf, "supplier")
    p = line.join(sup, line.l_suppkey == sup.s_suppkey).groupBy(F.col("s_nationkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.count("*").alias("score"))
    return agreement.mutual_best(p, "a", "b", "score")
