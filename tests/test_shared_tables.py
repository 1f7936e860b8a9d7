"""Queries join the driver's tables once a run and keep nothing for the next."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispersa.operators import classes
from dispersa.plans import bindings, registry


@pytest.mark.parametrize("name", ["d12_exclusions", "x4_ploidy_factors", "i11_parametric_p", "x1_selected_counts"])
def test_counts_are_joined_once(spark, name):
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f] and not bindings._WRITTEN


def test_the_overlap_range_needs_no_tails(spark, monkeypatch):
    """The range is over ratios of counts; the tables of log-factorials behind p grow with the features."""
    monkeypatch.setattr(classes, "log_factorials", None)
    assert registry.queries()["k6_overlap_range"](spark, "/root/testdata/sf0.001").first().half_range > 0


def test_published_counts_are_joined_once(spark):
    """Filters, exposures and fits of all sources read counts that are written, not the driver's tables again."""
    out = registry.queries()["v2_fit_sources"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_counts_lie_by_customer(spark):
    """Line items are dealt by customer to many tasks, so a unit's rows are in one part and its total needs no row of another."""
    rows = bindings._counted(spark, "/root/testdata/sf0.001").select("unit", F.spark_partition_id().alias("part")).distinct().collect()
    assert len({r.unit for r in rows}) == len(rows) and len({r.part for r in rows}) > 4


@pytest.mark.parametrize("name", ["x3_decomposition", "x2_correlations"])
def test_broadcasts_wait_for_no_sums(spark, name):
    """Fits, pair sums and lambdas are written before they are broadcast: with the driver's broadcast timeout a slow sum behind a broadcast is an error."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and len(plan.split("Relation")) < 20


def test_pair_sums_hold_a_constant_and_a_unit_without_counts(spark):
    from dispersa.operators import coexpression

    units = spark.createDataFrame([("A", f"u{i}", 1.0 + i % 2) for i in range(6)], "dataset string, unit string, expo double")
    counts = spark.createDataFrame([("A", f"u{i}", f, y) for i, (y1, y2) in enumerate([(1, 2), (0, 3), (4, 1), (2, 2), (5, 0)]) for f, y in (("a", y1), ("b", y2)) if y], "dataset string, unit string, feature string, y long")
    fits = spark.createDataFrame([("A", "a", 1.2, 0.3), ("A", "b", 0.9, 0.0), ("A", "c", 0.0, 0.0)], "dataset string, feature string, mu double, disp double")
    long = coexpression.pearson_residuals(counts, units, fits)
    want = {(r.unit, r.feature): r.r for r in long.collect()}
    got = {(r.unit, f): x for r in coexpression.residual_vectors(counts, units, fits).collect() for f, x in zip(r.names, r.x)}
    assert got == want and len(got) == 18
    pairs = {(r.i, r.j): r.r for r in coexpression.vector_correlations(coexpression.residual_vectors(counts, units, fits), shrink=False).collect()}
    assert pairs["a", "c"] == pairs["b", "c"] == 0 and abs(pairs["a", "b"] - np.corrcoef([want[f"u{i}", "a"] for i in range(6)], [want[f"u{i}", "b"] for i in range(6)])[0, 1]) < 1e-12
