"""Queries on correlation tables, axes and feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispersa.operators import axes, bootstrap, classes, coexpression, fitting, offsets, qc, reports, resampling, spectra
from dispersa.plans.bindings import COUNTS_SQL, counts
from dispersa.plans.count_queries import _expo, _pairs as _units_pairs
from dispersa.plans.registry import register, rounded
from dispersa.plans.class_queries import CLASSED, PARTS_SQL, _classed, part_tests
from dispersa.sources.results import checkpointed

WITH = "WITH " + COUNTS_SQL.strip()


def _fits(counts, units):
    """Moment fits for residuals, written: they are broadcast, and a broadcast must not wait for the sums behind them."""
    return checkpointed(fitting.moment_fit(fitting.sufficient(counts, units)).select("dataset", "feature", "mu", F.greatest("disp_moment", F.lit(0.0)).alias("disp")))


def _residuals(spark, sf, dataset):
    c, u = counts(spark, sf).where(F.col("dataset") == dataset), _expo(spark, sf).where(F.col("dataset") == dataset)
    return u, coexpression.pearson_residuals(c, u, _fits(c, u))


def _views(spark, sf, *datasets):
    """The datasets' pair tables, from one pass over units."""
    c, u = counts(spark, sf), _expo(spark, sf)
    if len(datasets) < 4:
        c, u = c.where(F.col("dataset").isin(*datasets)), u.where(F.col("dataset").isin(*datasets))
    pairs = coexpression.vector_correlations(coexpression.residual_vectors(c, u, _fits(c, u)))
    return {d: pairs.where(F.col("dataset") == d).drop("dataset") for d in datasets}


def _pairs(spark, sf, dataset):
    return _views(spark, sf, dataset)[dataset]


@register("x3_decomposition")
def decomposition(spark, sf):
    return rounded(coexpression.decompose(_views(spark, sf, "MIX.SC", "MIX.SE", "HYB.SC", "HYB.SE")))


@register("x5_bootstrap_pairs")
def pair_errors(spark, sf):
    u, r = _residuals(spark, sf, "MIX.SC")
    placed = resampling.positions(u, "dataset", "unit")
    w = resampling.bootstrap_weights(placed.groupBy("stratum").agg(F.count("*").alias("n")), 20, 4)
    got = axes.bootstrap_pairs(r.select("unit", "feature", "r"), w.join(placed, ["stratum", "pos"]).select("draw", "unit", "w"))
    return rounded(axes.normal_p(got, "mean", "se"))


@register("x8_candidate_axes")
def candidates(spark, sf):
    return rounded(axes.candidate_axes(spectra.leading_axes(_pairs(spark, sf, "MIX.SC"), "r", 40)))


@register("g1_signed_sets", f"""{PARTS_SQL} SELECT CASE WHEN est > 0 THEN 'disp_up' ELSE 'disp_down' END AS set_name, p_partkey AS feature, CAST(row_number() OVER (PARTITION BY est > 0 ORDER BY abs(est) DESC, p_partkey) AS INT) AS ord FROM pv WHERE p < 0.2 AND est <> 0""")
def signed(spark, sf):
    return axes.signed_sets(part_tests(spark, sf), "p_partkey", "est", "p", "disp", 0.2)


@register("g2_class_sets", f"""{CLASSED} SELECT concat(reg, CASE WHEN est > 0 THEN '.up' ELSE '.down' END) AS set_name, p_partkey AS feature FROM cl WHERE p < 0.3 AND est <> 0""")
def by_class(spark, sf):
    return axes.class_sets(_classed(spark, sf), "p_partkey", "reg", "est", "p", 0.3)


@register("k14_typed_pairs", f"""{WITH}, f AS (SELECT DISTINCT feature, CASE WHEN feature < 'Brand#2' THEN 'POS' WHEN feature < 'Brand#4' THEN 'NEG' END AS pole FROM counts)
SELECT a.feature AS i, b.feature AS j, CASE WHEN a.pole = b.pole THEN concat('within_', a.pole) WHEN a.pole <> b.pole THEN 'cross' END AS type FROM f a JOIN f b ON a.feature < b.feature""")
def typed(spark, sf):
    f = counts(spark, sf).select("feature").distinct()
    poles = f.withColumn("pole", F.when(F.col("feature") < "Brand#2", "POS").when(F.col("feature") < "Brand#4", "NEG")).where("pole IS NOT NULL")
    pairs = f.select(F.col("feature").alias("i")).join(f.select(F.col("feature").alias("j")), F.col("i") < F.col("j"))
    return axes.typed_pairs(pairs, poles)


@register("e10_median_libraries", f"""{WITH}, r AS (SELECT dataset, lib, row_number() OVER (PARTITION BY dataset ORDER BY lib DESC, unit) AS rk, count(*) OVER (PARTITION BY dataset) AS n FROM units),
k AS (SELECT dataset, any_value(n) AS n, CAST(round_even(0.4 * any_value(n), 0) AS BIGINT) AS k FROM r GROUP BY dataset),
p AS (SELECT DISTINCT dataset, CAST(round_even(1 + j * CASE WHEN k > 1 THEN (n - 1) / (k - 1) ELSE 0 END, 0) AS BIGINT) AS rk FROM (SELECT *, unnest(range(k)) AS j FROM k))
SELECT r.dataset, CASE WHEN p.rk IS NULL THEN 't' ELSE 'c' END AS side, count(*) AS n, round(quantile_cont(lib, 0.5), 6) AS median_lib FROM r LEFT JOIN p ON r.dataset = p.dataset AND r.rk = p.rk GROUP BY ALL""")
def report(spark, sf):
    got = offsets.depth_split(offsets.depth_order(qc.unit_totals(counts(spark, sf))), 0.4)
    return rounded(got.groupBy("dataset", "side").agg(F.count("*").alias("n"), F.percentile("lib", 0.5).alias("median_lib")))


@register("k13_trans_shares", f"{CLASSED} SELECT family, round(avg(CASE WHEN reg IN ('Trans', 'Cis + Trans', 'Compensatory') THEN 1.0 ELSE 0.0 END), 6) AS share FROM cl GROUP BY family")
def trans(spark, sf):
    any_trans = F.col("reg").isin("Trans", "Cis + Trans", "Compensatory")
    return rounded(_classed(spark, sf).where("reg IS NOT NULL").groupBy("family").agg(F.avg(any_trans.cast("int")).alias("share")))


@register("k6_overlap_range")
def overlap_range(spark, sf):
    t = _classed(spark, sf)
    both = classes.overlap_ratios(t, "reg", "dom").select("lor").union(classes.overlap_ratios(t, "reg", "family").select("lor"))
    return rounded(both.agg(F.max(F.abs("lor")).alias("half_range")))


@register("x7_rank_fit")
def rank_fit(spark, sf):
    pairs = checkpointed(_pairs(spark, sf, "MIX.SC"))
    axis = checkpointed(spectra.leading_axes(pairs, "r", 3))
    out = spectra.rank_fit(pairs, "r", axis, 1)
    for k in (2, 3):
        out = out.union(spectra.rank_fit(pairs, "r", axis, k))
    return rounded(out)


def _shared_fits(c, u):
    fits = _fits(c, u)
    shared = fits.groupBy("feature").agg(F.count_distinct("dataset").alias("n")).where("n = 4").select("feature")
    return fits.join(shared, "feature")


def _all_residuals(spark, sf):
    """Residuals of both parents and both alleles, on the features that all four have a fit of."""
    c, u = counts(spark, sf), _expo(spark, sf)
    return coexpression.pearson_residuals(c, u, _shared_fits(c, u))


def _all_vectors(spark, sf):
    """_all_residuals as one array a unit."""
    c, u = counts(spark, sf), _expo(spark, sf)
    return coexpression.residual_vectors(c, u, _shared_fits(c, u)).drop("names")


#: Relabellings of the null spectra in the registered query; the library takes any number.
SPECTRUM_DRAWS = 1000


@register("x10_permutation_spectra")
def permutation_spectra(spark, sf):
    """Observed squared eigenvalues with their rank-matched p."""
    got = checkpointed(spectra.permutation_spectra(_all_vectors(spark, sf), SPECTRUM_DRAWS))
    return rounded(spectra.spectrum_p(got.where("draw = 0"), got.where("draw > 0")))


@register("x12_validated_axes")
def validated(spark, sf):
    """The ten leading axes of total, cis and trans with q over these candidates."""
    got = checkpointed(spectra.permutation_spectra(_all_vectors(spark, sf), SPECTRUM_DRAWS))
    tests = checkpointed(spectra.spectrum_p(got.where("draw = 0"), got.where("draw > 0")))
    return rounded(spectra.validated_axes(tests, tests.where("rank <= 10")))


@register("x11_recoloured_spectra")
def recoloured_spectra(spark, sf):
    """Null spectra of the summed hybrid against the first parent, over resamples within the recoloured groups."""
    c, u = counts(spark, sf), _expo(spark, sf)
    hybrid = c.where(F.col("dataset").startswith("HYB.")).groupBy("feature", "unit").agg(F.sum("y").alias("y")).withColumn("dataset", F.lit("HYB.COMB"))
    both = u.where(F.col("dataset").startswith("HYB.")).groupBy("unit").agg((2 * F.max("expo")).alias("expo")).withColumn("dataset", F.lit("HYB.COMB"))
    parent = c.where("dataset = 'MIX.SC'").select(hybrid.columns), u.where("dataset = 'MIX.SC'").select(both.columns)
    rows, units = parent[0].union(hybrid), parent[1].union(both)
    fits = fitting.moment_fit(fitting.sufficient(rows, units)).select("dataset", "feature", "mu", F.greatest("disp_moment", F.lit(0.0)).alias("disp"))
    shared = fits.groupBy("feature").agg(F.count("*").alias("n")).where("n = 2").select("feature")
    residuals = coexpression.pearson_residuals(rows, units, fits.join(shared, "feature"))
    shift = reports.ploidy_shift(fitting.allele_components(c, u, offsets.share_terms(_units_pairs(spark, sf))))
    squares = reports.ploidy_factor(fits.join(shared, "feature").where("dataset = 'HYB.COMB'"), shift)
    factors = [r.f2**0.5 for r in squares.orderBy("feature").collect()]  # one number a feature
    groups = [checkpointed(spectra.unit_vectors(residuals, [v])) for v in ("MIX.SC", "HYB.COMB")]
    p, h, _ = spectra.recoloured(*groups, factors)
    placed = bootstrap.coexpression_units(u).where("grp IN (0, 2)").withColumn("grp", (F.col("grp") / 2).cast("int"))
    null = spectra.hashed_recoloured_spectra(p, h, placed, SPECTRUM_DRAWS, 2, factors, part="par_sc")
    return rounded(null.groupBy("part", "rank").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("upper")))
