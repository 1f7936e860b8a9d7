"""Weighted rendezvous hashing of stable record keys [native]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which the rows of one shard are numbered apart from each other.
SLOT_BUCKETS = 1024


def rendezvous(key: Sequence[str], weights: Sequence[float]) -> Column:
    """Shard of a key: the highest of the shards' weighted scores, -weight / ln(u).

    u in (0, 1) comes from XXH64 of the key and the shard's number, so a shard's score never depends
    on the other shards: one more shard takes rows only into itself, and a change of one weight moves
    rows only to or from that shard. Null key parts hash like the seed, so null keys share a shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scored = []
    for j, w in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(j)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        scored.append(F.struct((-F.ln(u) / float(w)).alias("cost"), F.lit(j).alias("shard")))
    return F.least(*scored)["shard"] if len(scored) > 1 else F.lit(0)


def assign_shards(df: DataFrame, key: Sequence[str], weights: Sequence[float], into: str = "shard") -> DataFrame:
    """The records with their shard; a projection, nothing is shuffled. Repeated keys stay together."""
    return df.withColumn(into, rendezvous(key, weights))


def number_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", into: str = "slot") -> DataFrame:
    """A gapless position from 0 in each shard, the same on every run.

    Columns other than `order` and the shard are dropped. Equal rows are counted before the shuffle and
    spread out again after it, so repeated rows of any number are one row while they are moved. Rows
    are numbered in SLOT_BUCKETS hash buckets a shard; a small table of counts gives each its base.
    """
    rows = df.groupBy(shard, *order).agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)))
    sums = rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    rows = rows.join(base, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    first = F.col("_base") + F.col("_first")
    return rows.select(shard, *order, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(into))


def op3_shards(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard, slot and grown shard of each document.

    Null text: 0 bytes, crc32 of empty text. Null doc_id: hashed as one key. Empty table: no rows.
    Other columns of the input are ignored.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(rows, ["doc_id"], weights)
    out = number_slots(rows, ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), rendezvous(["doc_id"], [*weights, 1.0]).cast("int").alias("grown_shard"),
    )
