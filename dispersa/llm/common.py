"""Helpers shared by the corpus operators: tables in the shared folder, text buffers, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut into pieces of about this many text bytes before numpy works on them.
PIECE_BYTES = 1 << 19


#: Rows and bytes of an Arrow batch of documents, which bound what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2500, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of documents fit two workers beside an executor's heap; the queries and the pipeline ask for it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, after whose end a task returns free memory to the system: idle Python workers stay beside the running ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, for a query or the pipeline."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_before.get() if set_before.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-dispersa-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key as text, mod `modulus`; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the least node.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, so that no
    group is ever collected; every round is written to the shared folder. Self edges are kept as
    single nodes. Rounds grow with the logarithm of the node count and end when all links form stars, each around its least node.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    link = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(link):
        both = link.union(link.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        link, old = materialise(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()), link
        drop_table(old)
    return nodes.join(link.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _stars(link: DataFrame) -> bool:
    """Whether each node has one link to a lesser one at most, and none of those that have is such a lesser one."""
    ends = link.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(link.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 OR up = 1 AND top = 1").isEmpty()


def ranked(df: DataFrame, group: str | None, key: list[str], buckets: int = 1024) -> DataFrame:
    """Add `rank`: gapless from 0 within `group` (or overall), without one task per group.

    Rows go to `buckets` hash buckets of the key within their group; the buckets' counts give each a
    base, and only rows of one bucket are numbered together.
    """
    groups = [group] if group else []
    if not group:
        df = df.withColumn("_g", F.lit(0))
    by = groups or ["_g"]
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    from pyspark.sql import Window

    counts = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*key)
    numbered = cut.withColumn("_r", F.row_number().over(inside))
    out = numbered.join(base.withColumnsRenamed({x: f"_b{x}" for x in [*by, "_bucket"]}), [F.col(x).eqNullSafe(F.col(f"_b{x}")) for x in [*by, "_bucket"]])
    out = out.withColumn("rank", F.col("_base") + F.col("_r") - 1)
    return out.drop("_bucket", "_base", "_r", "_g", *[f"_b{x}" for x in [*by, "_bucket"]])
