"""Queries on summaries of fits and splits, set operations, tails of tests and cluster diagnostics."""

from __future__ import annotations

import tempfile

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dispersa.functions import stats, tails
from dispersa.operators import contrasts, fitting, offsets, reports, resampling, states
from dispersa.plans.bindings import counts
from dispersa.plans.count_queries import _MODES, EXPO, PAIRS, STATS, WITH, _expo, _pairs, _units
from dispersa.plans.registry import _ORACLE, register, rounded
from dispersa.plans.class_queries import CLASSED, PARTS_SQL, _classed, part_tests
from dispersa.session import read_table
from dispersa.sources import results

FITS_SQL = f"{STATS}, f AS (SELECT dataset, feature, mu, CASE WHEN disp_moment > 0 THEN disp_moment ELSE 0.0 END AS disp FROM mom)"


def _fits(spark, sf):
    got = fitting.moment_fit(fitting.sufficient(counts(spark, sf), _expo(spark, sf)))
    return got.select("dataset", "feature", "mu", F.when(F.col("disp_moment") > 0, F.col("disp_moment")).otherwise(0.0).alias("disp"))


def _sub(name: str) -> str:
    """A registered query's SQL as a subquery."""
    return f"({_ORACLE[name]})"


@register("d13_flag_sizes", f"{FITS_SQL}, u AS (UNPIVOT (SELECT dataset, disp = 0 AS zero_boundary, mu < 0.5 AS low_mean, disp > 0 AND mu * disp > 1 AS over_dispersed FROM f) ON zero_boundary, low_mean, over_dispersed INTO NAME flag VALUE v) SELECT dataset, flag, count_if(v) AS n FROM u GROUP BY ALL")
def flag_sizes(spark, sf):
    f = _fits(spark, sf)
    marked = f.select("dataset", (F.col("disp") == 0).alias("zero_boundary"), (F.col("mu") < 0.5).alias("low_mean"), ((F.col("disp") > 0) & (F.col("mu") * F.col("disp") > 1)).alias("over_dispersed"))
    return reports.flag_sizes(marked, ["zero_boundary", "low_mean", "over_dispersed"], ["dataset"])


def _components(spark, sf):
    return rounded(fitting.allele_components(counts(spark, sf), _expo(spark, sf), offsets.share_terms(_pairs(spark, sf))))


@register("d15_noise_parts", f"SELECT feature, sigma_q AS intr, sigma_d AS extr, delta AS log_shift, delta_raw AS raw_shift FROM {_sub('d14_allele_components')}")
def noise_parts(spark, sf):
    c = _components(spark, sf)
    out = reports.intrinsic_extrinsic(c)
    for scale, name in (("log2", "log_shift"), ("raw", "raw_shift")):
        out = out.join(reports.ploidy_shift(c, scale).withColumnRenamed("shift", name), "feature")
    return out


@register("x4_ploidy_factors", f"""{FITS_SQL}, x AS (SELECT f.dataset, f.feature, pow(2, -delta) AS g, 1 + disp * mu AS a, disp * mu AS b FROM f LEFT JOIN {_sub('d14_allele_components')} d ON f.feature = d.feature)
SELECT dataset, feature, CASE WHEN g IS NULL OR g + b = 0 THEN 1.0 ELSE round(g * a / (g + b), 4) END AS f2 FROM x""")
def ploidy_factors(spark, sf):
    return rounded(reports.ploidy_factor(_fits(spark, sf), reports.ploidy_shift(_components(spark, sf))), 4)


@register("d7_mean_errors", f"""{FITS_SQL} SELECT f.dataset, feature, round(1 / sqrt(sum(mu * expo / (1 + disp * mu * expo))), 6) AS se FROM f JOIN expo e ON f.dataset = e.dataset WHERE mu > 0 GROUP BY ALL""")
def mean_errors(spark, sf):
    return rounded(reports.asymptotic_mean_se(_fits(spark, sf), _expo(spark, sf)))


@register("d19_weighted_medians", f"""{FITS_SQL}, w AS (SELECT f.dataset, f.feature, round(mu, 6) AS mu, sy FROM f JOIN st ON f.dataset = st.dataset AND f.feature = st.feature), p AS (SELECT dataset, mu, sum(sy) AS w FROM w GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY dataset ORDER BY mu) AS up, sum(w) OVER (PARTITION BY dataset) AS t FROM p) SELECT dataset, min(mu) AS median FROM c WHERE 2 * up >= t GROUP BY dataset""")
def weighted_medians(spark, sf):
    s = fitting.sufficient(counts(spark, sf), _expo(spark, sf))
    f = rounded(fitting.moment_fit(s).select("dataset", "feature", "mu")).join(s.select("dataset", "feature", "sy"), ["dataset", "feature"])
    return reports.weighted_median(f, "mu", "sy", ["dataset"])


@register("c9_ratio_axes", f"""{FITS_SQL}, p AS (SELECT a.feature, a.mu AS ma, b.mu AS mb, a.disp AS da, b.disp AS db FROM f a JOIN f b USING (feature) WHERE a.dataset = 'MIX.SC' AND b.dataset = 'MIX.SE')
SELECT feature, round(CASE WHEN ma > 0 AND mb > 0 THEN log2(ma) - log2(mb) END, 6) AS mu, CASE WHEN da > 0 AND db > 0 THEN round(log2(da) - log2(db), 6) END AS disp,
CASE WHEN ma > 0 AND mb > 0 THEN round(log2(da + 1 / ma) - log2(db + 1 / mb), 6) END AS cv2, round(da - db, 6) AS rdisp FROM p""")
def ratio_axes(spark, sf):
    return rounded(reports.ratio_axes(_fits(spark, sf), "MIX.SC", "MIX.SE"))


@register("c7_burst_contrasts", f"""{FITS_SQL}, mg AS ({_MODES}) SELECT feature, mode, CASE WHEN count(*) = any_value(k) THEN round(sum(weight * mu * disp), 5) END AS bsize,
CASE WHEN count(*) FILTER (mu > 0 AND disp > 0) = any_value(k) THEN round(sum(weight / (mu * disp * disp)) FILTER (mu > 0 AND disp > 0), 3) END AS kbal FROM f JOIN mg USING (dataset) GROUP BY ALL""")
def bursts(spark, sf):
    modes = {m: g for m, g in contrasts.MODE_GROUPS.items() if m in ("total", "mid", "par_sc", "par_se")}
    got = reports.burst_contrasts(_fits(spark, sf), contrasts.mode_groups(spark, modes))
    return got.select("feature", "mode", F.round("bsize", 5).alias("bsize"), F.round("kbal", 3).alias("kbal"))


@register("e4_share_offsets", f"""{PAIRS}, s AS (SELECT CAST(unit AS BIGINT) % 4 AS subset, a / (a + b) AS share FROM pairs WHERE a + b > 0), w AS (SELECT avg(share) AS m FROM s)
SELECT subset, round(log2(avg(share) / (1 - avg(share))), 6) AS offset_log2, round(log2(avg(share) / (1 - avg(share))) - log2(any_value(m) / (1 - any_value(m))), 6) AS difference FROM s, w GROUP BY subset""")
def share_offsets(spark, sf):
    p = _pairs(spark, sf).where("a + b > 0").select(F.pmod(F.col("unit").cast("long"), F.lit(4)).alias("part"), (F.col("a") / (F.col("a") + F.col("b"))).alias("share"))
    return rounded(reports.share_offsets(p, "part").withColumnRenamed("offset", "offset_log2"))


@register("e5_share_term", f"""{FITS_SQL}, pr AS (SELECT coalesce(x.lib, 0) AS a, coalesce(z.lib, 0) AS b FROM (SELECT * FROM units WHERE dataset = 'HYB.SC') x FULL JOIN (SELECT * FROM units WHERE dataset = 'HYB.SE') z ON x.unit = z.unit),
c AS (SELECT a / (a + b) AS c, a / (a + b) * (b / (a + b)) / (a + b - 1) AS v FROM pr WHERE a + b > 1), t AS (SELECT avg(c) AS cbar, greatest(var_samp(c) - avg(v), 0) AS var_c FROM c),
m AS (SELECT dataset, quantile_cont(disp, 0.5) AS median_disp FROM f WHERE disp > 0 GROUP BY dataset), r AS (SELECT dataset, CASE dataset WHEN 'HYB.SC' THEN var_c / (cbar * cbar) WHEN 'HYB.SE' THEN var_c / ((1 - cbar) * (1 - cbar)) ELSE 0 END AS share_r, median_disp FROM m, t)
SELECT dataset, round(share_r, 6) AS share_r, round(median_disp, 6) AS median_disp, round(share_r / median_disp, 6) AS relative FROM r""")
def share_term(spark, sf):
    f = _fits(spark, sf)
    terms = offsets.share_correction(f.select("dataset").distinct(), offsets.share_terms(_pairs(spark, sf)))
    return rounded(reports.share_term(terms, f))


PILOT_SQL = f"""{WITH}, sz AS (SELECT dataset, count(*) AS n FROM units GROUP BY dataset), g AS (SELECT c.dataset, feature, sum(y) AS s, sum(y * y) AS q, any_value(n) AS n FROM counts c JOIN sz USING (dataset) GROUP BY ALL),
se AS (SELECT feature, dataset, sqrt((q / n - s / n * (s / n)) / n) / (s / n) AS se FROM g), w AS (SELECT feature, unit, sum(CASE WHEN dataset = 'HYB.SC' THEN y ELSE 0 END) AS a, sum(CASE WHEN dataset = 'HYB.SE' THEN y ELSE 0 END) AS b FROM counts WHERE dataset LIKE 'HYB%' GROUP BY ALL),
cv AS (SELECT feature, (sum(a * b) / any_value(n) - sum(a) / any_value(n) * (sum(b) / any_value(n))) / any_value(n) / (sum(a) / any_value(n) * (sum(b) / any_value(n))) AS cov FROM w, (SELECT n FROM sz WHERE dataset = 'HYB.SC') GROUP BY feature HAVING sum(a) > 0 AND sum(b) > 0),
pi AS (SELECT p.feature, p.se AS p, q.se AS q, x.se AS x, y.se AS y, cov FROM (SELECT * FROM se WHERE dataset = 'MIX.SC') p JOIN (SELECT * FROM se WHERE dataset = 'MIX.SE') q USING (feature) JOIN (SELECT * FROM se WHERE dataset = 'HYB.SC') x USING (feature) JOIN (SELECT * FROM se WHERE dataset = 'HYB.SE') y USING (feature) JOIN cv USING (feature))"""


def _pilot(spark, sf):
    c = counts(spark, sf)
    return reports.delta_pilot(c, _units(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")))


@register("i4_delta_pilot", f"{PILOT_SQL} SELECT feature, dataset, round(se, 6) AS se FROM se UNION ALL SELECT feature, 'cov', round(cov, 6) FROM cv")
def pilot(spark, sf):
    return rounded(_pilot(spark, sf))


@register("e9_split_fractions", f"""{PILOT_SQL}, k AS (SELECT 1000.0 * (x * x + y * y - 2 * cov) AS a, p * p + q * q AS b, cov / (x * y) AS rho FROM pi), m AS (SELECT quantile_cont(b, 0.5) * 1000 / quantile_cont(a, 0.5) AS r, count(*) AS features, quantile_cont(rho, 0.5) AS correlation FROM k WHERE a > 0)
SELECT round(r, 6) AS r, round(((2 + r) - sqrt(r * r + 4)) / (2 * r), 6) AS fraction, features, round(correlation, 6) AS correlation FROM m""")
def fractions(spark, sf):
    return rounded(reports.split_fractions(_pilot(spark, sf), F.lit(1000.0)))


@register("e10_partition_report", f"""{EXPO}, r AS (SELECT dataset, unit, row_number() OVER (PARTITION BY dataset ORDER BY lib DESC, unit) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM units)
SELECT dataset, CAST(round_even(0.4 * any_value(n), 0) AS BIGINT) AS n_cis, CAST(any_value(n) - round_even(0.4 * any_value(n), 0) AS BIGINT) AS n_trans, least(round_even(0.4 * any_value(n), 0), any_value(n) - round_even(0.4 * any_value(n), 0)) < 800 AS below_least FROM r GROUP BY dataset""")
def partitions(spark, sf):
    return reports.partition_report(offsets.depth_split(offsets.depth_order(_units(spark, sf)), 0.4), 800)


@register("i18_structural", f"""{PARTS_SQL}, s AS (SELECT var_samp(est) - avg(p * p) AS vm, var_samp(est2) - avg(p2 * p2) AS vf, covar_samp(est, est2) AS cmf FROM pv), v AS (SELECT *, sqrt(vf * (vm + vf + 2 * cmf)) AS sc FROM s)
SELECT round((cmf + vf) / sc, 6) AS observed, round(vf / sc, 6) AS forced, round((cmf + vf) / sc - vf / sc, 6) AS excess FROM v""")
def structural(spark, sf):
    d = resampling.disattenuated(part_tests(spark, sf), "est", "est2", "p", "p2")
    return rounded(reports.structural_correlation(d.select(F.col("var_x").alias("vm"), F.col("var_y").alias("vf"), F.col("cov").alias("cmf"))))


@register("i24_rejections", f"{PARTS_SQL} SELECT family, round(avg(CAST(p < 0.05 AS INT)), 6) AS first, round(avg(CAST(p2 < 0.05 AS INT)), 6) AS second FROM pv GROUP BY family")
def rejections(spark, sf):
    t = part_tests(spark, sf)
    long = t.select("family", F.lit("first").alias("quantity"), "p").unionByName(t.select("family", F.lit("second").alias("quantity"), F.col("p2").alias("p")))
    return rounded(reports.rejection_table(long, ["family"], "quantity", "p"))


@register("j3_common_features", f"{WITH} SELECT feature FROM counts GROUP BY feature HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM counts)")
def common(spark, sf):
    return reports.common_features(counts(spark, sf))


@register("u1_unit_sets", f"""{WITH}, a AS (SELECT unit FROM units WHERE dataset = 'HYB.SC'), b AS (SELECT unit FROM units WHERE dataset = 'HYB.SE')
SELECT 'either' AS part, count(*) AS n FROM (SELECT unit FROM a UNION SELECT unit FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT unit FROM a INTERSECT SELECT unit FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT unit FROM a EXCEPT SELECT unit FROM b)""")
def unit_sets(spark, sf):
    u = _units(spark, sf)
    a, b = (u.where(F.col("dataset") == d).select("unit") for d in ("HYB.SC", "HYB.SE"))
    parts = {"either": a.union(b).distinct(), "both": a.intersect(b), "first": a.exceptAll(b)}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@register("u3_prefixed_units", f"{WITH} SELECT 'P1_' || unit AS unit, feature, y FROM counts WHERE dataset = 'MIX.SC' UNION ALL SELECT 'P2_' || unit, feature, y FROM counts WHERE dataset = 'MIX.SE'")
def prefixed(spark, sf):
    c = counts(spark, sf).select("dataset", "unit", "feature", "y")
    return reports.prefixed_union({f"P{i}_": c.where(F.col("dataset") == d).drop("dataset") for i, d in ((1, "MIX.SC"), (2, "MIX.SE"))})


@register("u4_either_criterion", f"{FITS_SQL}, m AS (SELECT feature, avg(mu) AS mu, min(disp * mu / (1 + disp * mu)) AS rel FROM f GROUP BY feature) (SELECT feature FROM m ORDER BY round(mu, 9) DESC, feature LIMIT 5) UNION SELECT feature FROM m WHERE rel > 0.02")
def either(spark, sf):
    f = _fits(spark, sf)
    m = f.groupBy("feature").agg(F.round(F.avg("mu"), 9).alias("mu")).join(fitting.reliability(f), "feature")
    return reports.either_criterion(m, "feature", "mu", 5, F.col("reliability") > 0.02)


@register("x1_selected_counts", f"{FITS_SQL}, m AS (SELECT feature, avg(mu) AS mu, min(disp * mu / (1 + disp * mu)) AS rel FROM f GROUP BY feature), k AS ((SELECT feature FROM m ORDER BY round(mu, 9) DESC, feature LIMIT 5) UNION SELECT feature FROM m WHERE rel > 0.02) SELECT dataset, count(*) AS cells, CAST(sum(y) AS BIGINT) AS y FROM counts SEMI JOIN k USING (feature) GROUP BY dataset")
def selected(spark, sf):
    return counts(spark, sf).join(either(spark, sf), "feature", "left_semi").groupBy("dataset").agg(F.count("*").alias("cells"), F.sum("y").alias("y"))


EMB_SQL = "WITH e AS (SELECT generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), v AS (SELECT dim, round(var_samp(x), 8) AS v FROM e GROUP BY dim)"


@register("w5_cumulative_variance", f"{EMB_SQL} SELECT CAST(dim AS INT) AS dim, row_number() OVER (ORDER BY v DESC, dim) AS rank, round(100 * v / sum(v) OVER (), 4) AS percent, round(100 * sum(v) OVER (ORDER BY v DESC, dim ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 4) AS cumulative FROM v")
def cumulative(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    v = e.groupBy((F.col("dim") + 1).alias("dim")).agg(F.round(F.var_samp(F.col("x").cast("double")), 8).alias("v"))
    return rounded(reports.cumulative_share(v, "v", "dim"), 4)


@register("w6_top_each", "SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_each(spark, sf):
    return reports.top_each(read_table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 3)


@register("w8_strongest", f"{PARTS_SQL} SELECT p_partkey, family, est FROM pv ORDER BY abs(est) DESC NULLS LAST, p_partkey LIMIT 25")
def strongest(spark, sf):
    return reports.strongest(part_tests(spark, sf).select("p_partkey", "family", "est"), "est", "p_partkey", 25)


@register("t12_signed_rank", """WITH d AS (SELECT o_orderpriority AS g, abs(round((o_totalprice - 150000) / 1000)) AS a, o_totalprice > 150000 AS up FROM orders WHERE round((o_totalprice - 150000) / 1000) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS r, count(*) OVER (PARTITION BY g, a) AS t FROM d), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN up THEN r ELSE 0 END) AS v, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY g)
SELECT g, CAST(n AS BIGINT) AS n, v, round((v - n * (n + 1) / 4 - 0.5 * sign(v - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""")
def signed_rank(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.round((F.col("o_totalprice") - 150000) / 1000).alias("d"))
    return rounded(reports.signed_rank(o, "d", ["g"]))


@register("g3_component_sets", f"""{CLASSED}, x AS (SELECT 'cis_' || CASE WHEN est > 0 THEN 'up' ELSE 'down' END AS "set", p_partkey FROM cl WHERE reg IN ('Cis', 'Cis + Trans', 'Compensatory') AND est <> 0 UNION ALL SELECT 'trans_' || CASE WHEN est2 > 0 THEN 'up' ELSE 'down' END, p_partkey FROM cl WHERE reg IN ('Trans', 'Cis + Trans', 'Compensatory') AND est2 <> 0)
SELECT "set", p_partkey FROM x""")
def component_sets(spark, sf):
    return reports.component_sets(_classed(spark, sf), "reg", {"cis": "est", "trans": "est2"}).select("set", "p_partkey")


TRACK_SQL = """WITH w AS (SELECT l_suppkey AS seqid, min(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS start FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey AS seqid, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS pos, l_discount AS v FROM lineitem)"""


def _track(spark, sf):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    t = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seqid"), day.alias("pos"), F.col("l_discount").cast("double").alias("v"))
    w = t.groupBy("seqid").agg(F.min("pos").alias("start")).withColumn("end", F.col("start") + 300)
    return w, t


@register("j8_contained", f"{TRACK_SQL} SELECT w.seqid, w.start, pos, v FROM w JOIN t ON w.seqid = t.seqid AND pos BETWEEN w.start AND w.start + 300")
def contained(spark, sf):
    w, t = _track(spark, sf)
    return reports.contained(w, t, 100).select("seqid", "start", "pos", "v")


@register("p5_mean_occupancy", f"{TRACK_SQL} SELECT w.seqid, count(v) AS n, round(avg(v), 6) AS occupancy FROM w LEFT JOIN t ON w.seqid = t.seqid AND pos BETWEEN w.start + 20 AND w.start + 300 GROUP BY w.seqid")
def occupancy(spark, sf):
    w, t = _track(spark, sf)
    return rounded(reports.mean_occupancy(w.withColumn("start", F.col("start") + 20), t, "v", ["seqid"], 100))


@register("l15_ratio_report", f"""WITH r AS (SELECT dataset, CASE WHEN "between" > 0 THEN round(greatest("within", 0) / "between", 6) END AS r FROM {_sub('d18_within_between')}) SELECT dataset, count(r) AS n, round(avg(CAST(r > 1 AS INT)), 6) AS share_above, count_if(r = 0) AS zero, round(quantile_cont(r, 0.5), 4) AS median FROM r GROUP BY dataset""")
def ratio_report(spark, sf):
    u = _expo(spark, sf)
    rows = rounded(states.within_between(counts(spark, sf), u, u.select("dataset", "unit", (F.col("unit").cast("long") % 3).alias("cluster"))))
    got = reports.ratio_report(rows, ["dataset"])
    return got.select("dataset", "n", F.round("share_above", 6).alias("share_above"), "zero", F.round("median", 4).alias("median"))


@register("q20_patterns", "SELECT p_partkey, round(p_retailprice / 7, 2) AS price FROM part WHERE regexp_matches(p_brand, '^Brand#[12]') AND NOT regexp_matches(p_type, 'BRASS$')")
def patterns(spark, sf):
    p = read_table(spark, sf, "part").where(F.col("p_brand").rlike("^Brand#[12]") & ~F.col("p_type").rlike("BRASS$"))
    return p.select("p_partkey", F.round(F.col("p_retailprice") / 7, 2).alias("price"))


def _folder(spark) -> str:
    try:
        return results.shared_folder(spark)
    except ValueError:  # local runs and tests
        if not spark.sparkContext.master.startswith("local["):
            raise
        return tempfile.mkdtemp(prefix="spark-dispersa-")


@register("s7_summary_table", "SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS mean, round(pow(stddev_samp(p_retailprice) / avg(p_retailprice), 2), 6) AS cv2 FROM part GROUP BY p_brand")
def summary_table(spark, sf):
    p = read_table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), (100 * F.stddev_samp("p_retailprice") / F.avg("p_retailprice")).alias("c"))
    path = f"{_folder(spark)}/s7-{spark.sparkContext.applicationId}"
    p.select(F.col("p_brand").alias("ORF"), F.col("m").alias("Mean"), F.col("c").alias("CV")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return rounded(results.read_summary(spark, path, {"feature": "ORF", "mean": "Mean", "noise": "CV"}, "percent"))


@register("s9_result_table", f"{WITH} SELECT dataset, unit, lib, det FROM units")
def result_table(spark, sf):
    path = f"{_folder(spark)}/s9-{spark.sparkContext.applicationId}"
    u = _units(spark, sf).select("dataset", "unit", "lib", "det")
    results.write_result(u, path, partition_by=["dataset"])
    return spark.read.schema(u.schema).parquet(path)


@register("t8_spearman_p")
def spearman_p(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", "o_custkey")
    s = stats.spearman(o, "o_totalprice", "o_custkey", ["g"])
    return s.withColumn("p", tails.correlation_p(F.col("rho"), F.col("n")))


@register("k9_anova_p")
def anova_p(spark, sf):
    a = stats.one_way_anova(read_table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return a.withColumn("p", tails.f_p(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")))


@register("t11_kruskal_p")
def kruskal_p(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k"), F.round(F.col("c_acctbal") / 100).alias("x"))
    sizes = c.groupBy("g").agg(F.count("x").alias("n"), F.count_distinct("k").alias("groups"))
    h = stats.kruskal_wallis(c, "x", "k", ["g"]).join(sizes, "g")
    eta = (F.col("h") - F.col("groups") + 1) / (F.col("n") - F.col("groups"))
    return h.withColumn("eta2", eta).withColumn("p", tails.chi2_p(F.col("h"), F.col("groups") - 1))


@register("t12_signed_rank_p")
def signed_rank_p(spark, sf):
    return signed_rank(spark, sf).withColumn("p", tails.normal_p(F.col("z")))


@register("i3_resample_weights")
def resample_weights(spark, sf):
    sizes = _units(spark, sf).groupBy(F.col("dataset").alias("stratum")).agg(F.count("*").alias("n"))
    return resampling.bootstrap_weights(sizes, 20, 7)


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.monotonically_increasing_id().alias("row"), "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))


@register("l5_cluster_stability")
def stability(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.xxhash64("embedding").alias("row"), array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    return reports.cluster_stability(e, "vec", "row", 4, 4)


@register("l12_discrete_state")
def discrete_state(spark, sf):
    out, k = states.best_partition(_vectors(spark, sf), "vec", [2, 3, 4], 1)
    return out.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@register("x13_axis_poles")
def axis_poles(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("x"))
    return reports.two_normals(p, "x", "p_partkey")
