"""The driver's tables as count tables: how each abstraction is bound, as DataFrames and as SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.session import read_table
from dispersa.sources.results import checkpointed

#: Tables that the running query has written, by application, folder and name.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def in_query(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with tables of its own: what it asks for through `once` is computed and written once in a run, and never kept for the next."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _WRITTEN.clear()
        _RUNNING.append(True)
        try:
            return query(spark, sf_dir)
        finally:
            _RUNNING.pop()
            _WRITTEN.clear()

    return run


_RUNNING: list[bool] = []


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that a registered query needs in several places; outside of a query it is made anew."""
    if not _RUNNING:
        return make()
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = checkpointed(make())
    return _WRITTEN[key]

#: Common table expressions with the same content as counts(), units() and flags().
COUNTS_SQL = """
lines AS (
  SELECT o_custkey, c_mktsegment, p_brand, l_linestatus, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
counts AS (
  SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'MIX.SC' WHEN 'MACHINERY' THEN 'MIX.SE'
              ELSE CASE l_linestatus WHEN 'F' THEN 'HYB.SC' ELSE 'HYB.SE' END END AS dataset,
         p_brand AS feature, CAST(o_custkey AS VARCHAR) AS unit, count(*) AS y
  FROM lines GROUP BY ALL),
units AS (SELECT dataset, unit, CAST(sum(y) AS BIGINT) AS lib, count(*) AS det FROM counts GROUP BY ALL)"""


def _tasks(spark: SparkSession) -> int:
    """Parts that keep all cores busy to the end, whatever their number is coalesced to elsewhere."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, feature, unit, y): line items of a customer by brand; two parents and two alleles of the other segments.

    Parts join first and customers join their orders, so that line items are dealt by order and then by customer only. All rows
    of a customer are in one file, so that totals of units add up where they are read.
    """
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    order = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    segment = F.col("c_mktsegment")
    parent = F.when(segment == "BUILDING", 0).when(segment == "MACHINERY", 1).alias("parent")
    owned = order.join(read_table(spark, sf_dir, "customer").select("c_custkey", parent), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "parent")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.coalesce("parent", F.when(F.col("l_linestatus") == "F", 2).otherwise(3)).alias("kind")
    cells = rows.select("o_custkey", kind, "p_brand").repartition(_tasks(spark), "o_custkey").groupBy("o_custkey", "kind", "p_brand").agg(F.count("*").alias("y"))
    dataset = F.when(F.col("kind") == 0, "MIX.SC").when(F.col("kind") == 1, "MIX.SE").when(F.col("kind") == 2, "HYB.SC").otherwise("HYB.SE")
    return cells.select(dataset.alias("dataset"), F.col("p_brand").alias("feature"), F.col("o_custkey").cast("string").alias("unit"), "y")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count table; the joins behind it run once in a query."""
    return once(spark, sf_dir, "counts", lambda: _counted(spark, sf_dir))
