"""Count matrices and result tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_wide_csv(spark: SparkSession, path: str, dataset: str, sep: str = ",") -> DataFrame:
    """(dataset, feature, unit, y) of a features x units file whose first column names features; zeros aren't kept."""
    names = header_fields(spark, path, sep)
    schema = T.StructType([T.StructField("feature", T.StringType()), *[T.StructField(f"u{i}", T.LongType()) for i in range(len(names) - 1)]])
    wide = spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=True)
    return _long(wide, names[1:]).select(F.lit(dataset).alias("dataset"), "feature", "unit", "y")


def header_fields(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Fields of the first line, without quotes."""
    line = spark.read.text(path).first()
    return [x.strip().strip('"') for x in (line[0] if line else "").split(sep)]


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    columns = [c for c in wide.columns if c != "feature"]
    units = F.array(*[F.lit(n) for n in names])
    each = wide.select("feature", F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_i", "y")).where("y > 0")
    return each.select("feature", F.element_at(units, F.col("_i") + 1).alias("unit"), "y")


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", keep: list[str] | None = None) -> DataFrame:
    """(feature, unit, y) of a delimited matrix whose header either names the first field or leaves it out; `keep` chooses units.

    Two lines settle which it is: a header that leaves it out has one field less than the rows.
    """
    lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    head, width = lines[0].split(sep), len(lines[1].split(sep)) if len(lines) > 1 else 0
    units = [x.strip('"') for x in (head if len(head) == width - 1 else head[1:])]
    schema = T.StructType([T.StructField("feature", T.StringType()), *[T.StructField(f"u{i}", T.DoubleType()) for i in range(len(units))]])
    wide = spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=True)
    chosen = [i for i, u in enumerate(units) if keep is None or u in keep]
    return _long(wide.select("feature", *[f"u{i}" for i in chosen]), [units[i] for i in chosen])


def numeric_columns(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """The table with numeric columns only, and the names of those with any value that is neither blank nor a number."""
    columns = [c for c in df.columns if c != key]
    number = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}
    bad = df.agg(*[F.count_if((F.trim(F.col(c)) != "") & number[c].isNull()).alias(c) for c in columns]).first() if columns else {}
    dropped = [c for c in columns if bad[c]]
    return df.select(key, *[number[c].alias(c) for c in columns if c not in dropped]), dropped


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(n, h): rows and the sum of their hashes, whatever their order; stored beside an output to tell what it was built from."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h"))


def read_replicates(spark: SparkSession, path: str, expected: dict[int, int]) -> DataFrame:
    """A table partitioned by `replicate`, after a check that each has its expected number of rows."""
    df = spark.read.parquet(path)
    have = dict(df.groupBy("replicate").count().collect())
    wrong = {k: (have.get(k, 0), n) for k, n in expected.items() if have.get(k, 0) != n}
    if wrong:
        raise ValueError(f"incomplete replicates (found, expected): {wrong}")
    return df


def require_grid(results: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """The results, after a check that every grid row has one."""
    missing = grid.join(results, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"rows without a result: {[r[key] for r in missing]}")
    return results
