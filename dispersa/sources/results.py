"""Result tables out, tables as checkpoints, and published summary tables in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only for a local master without either."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at and spark.sparkContext.master.startswith("local["):
        at = tempfile.mkdtemp(prefix="spark-dispersa-")
        spark.sparkContext.setCheckpointDir(at)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def write_result(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A result table as Parquet, or as CSV with a header for reports; an existing one is replaced."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by or [])
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: later steps don't repeat earlier ones, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/sections/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_summary(spark: SparkSession, path: str, names: dict[str, str], noise: str = "cv2") -> DataFrame:
    """(feature, mean, cv2) of a tab-separated summary table; rows with a missing value go.

    names: the file's column for each of feature, mean and noise. The noise column holds squared coefficients of variation
    ("cv2"), coefficients ("cv") or coefficients in percent ("percent").
    """
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    v = F.expr(f"try_cast(`{names['noise']}` AS DOUBLE)")
    v = v / 100 if noise == "percent" else v
    v = v if noise == "cv2" else v * v
    rows = raw.select(F.col(f"`{names['feature']}`").alias("feature"), F.expr(f"try_cast(`{names['mean']}` AS DOUBLE)").alias("mean"), v.alias("cv2"))
    return rows.dropna()
