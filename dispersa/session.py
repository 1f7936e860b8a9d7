"""Session helpers shared by the library's entry points."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    memory = os.environ.get("DISPERSA_DRIVER_MEMORY", "12g")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_dispersa_sent", False):
        return
    package = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="spark-dispersa-")) / "dispersa.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(to))
    context._dispersa_sent = True
