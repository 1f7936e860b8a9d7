"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import components, drop_table, give_back, materialise
from dispersa.llm.paragraphs import SHINGLE, SIMILARITY, Words, _factors, _mix, close_links, shingles, tune_bands

SEED = 42
#: Reference fingerprints are ORIGIN and SPREAD random ones.
ORIGIN = 0x9E3779B97F4A7C15
BLOCKS = ((0, 16), (16, 32), (32, 48), (48, 64))
SPREAD = 8
#: Buckets with more distinct fingerprints than this are linked through midpoints instead of pairs.
BUCKET = 32


def _shingle_hashes(text: str, k: int) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    rows = zip(*[words[i:] for i in range(k)], strict=False)
    return np.fromiter((digest(b" ".join(r), SEED) for r in rows), np.uint64, len(words) - k + 1)


def fingerprint(text: str, k: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    h = _shingle_hashes(text, k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):
        part = h[low : low + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp BIGINT) of each row, over whole texts with ASCII letters lower-cased; null text: no words, 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.fromiter((fingerprint(t.as_py() or "", k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


def pivot_table(fps: DataFrame, pivots: int = SPREAD + 1) -> DataFrame:
    """fp with `far`, its Hamming distances to the reference fingerprints, the same ones at every call."""
    rng = np.random.Generator(np.random.Philox(SEED))
    references = [ORIGIN, *(int(x) for x in rng.integers(0, 1 << 64, SPREAD, dtype=np.uint64))][:pivots]
    return fps.select("fp", F.array(*[_distance(F.col("fp"), p) for p in references]).alias("far"))


def close_pairs(fps: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints, with every pair at distance <= `most` (1 or 2) connected.

    Any two such fingerprints agree in at least two of the four blocks of 16 bits, so only pairs that agree in two are looked at. Of
    these, the pivot table discards those whose largest coordinate difference exceeds `most` (a distance to a
    reference can't differ by more than the distance between the two), and the rest are verified. A bucket of
    over `bucket` fingerprints isn't paired up: its members meet at the fingerprints within one bit of them,
    where two members are at distance <= 2 exactly if they share one, and are linked to the
    least there. So no bucket makes more than a fixed number of rows for each member.
    """
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2")
    part = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(0xFFFF).cast("long")) for low, _ in BLOCKS]
    keys = [F.shiftleft(F.shiftleft(part[i], 16).bitwiseOR(part[j]), 3) + n for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    keyed = pivot_table(fps).select("fp", "far", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = materialise(keyed.join(sizes, "key"))
    small = keyed.where(F.col("size") <= bucket)
    left, right = small.select("key", F.col("fp").alias("a"), F.col("far").alias("fa")), small.select("key", F.col("fp").alias("b"), F.col("far").alias("fb"))
    apart = F.array_max(F.zip_with("fa", "fb", lambda x, y: F.abs(x - y)))
    pairs = left.join(right, "key").where("a < b").where(apart <= most)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")
    crowd = keyed.where(F.col("size") > bucket).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)]
    if most == 1:
        near = crowd.select("fp", F.explode(F.array(*flips)).alias("mid")).join(crowd.select(F.col("fp").alias("mid")), "mid")
        met = near.where("fp <> mid").select(F.col("fp").alias("a"), F.col("mid").alias("b"))
    else:
        near = crowd.select("fp", F.explode(F.array(*flips)).alias("mid"))
        least = near.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).where("b <> _top").select("mid", "b")
        met = near.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(met).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id that links of <= `most` differing bits reach.

    Rows with equal fingerprints are one node, so copies of any number cost no links. Texts without words
    have fingerprint zero and link like any other. Null ids are kept; such a row's component is the least id
    that isn't null. Repeated rows are returned as often as they are there.
    """
    rows = materialise(fingerprints(docs, k))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reach = components(close_pairs(nodes.select("fp"), most))
    named = nodes.join(reach, nodes.fp == reach.node, "left").select(nodes.fp.alias("_fp"), F.coalesce("component", nodes.fp).alias("c"), "least")
    heads = named.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "c").select("_fp", "component_id")
    return rows.join(classes, rows.fp == classes._fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, k: int = 3, most: int = 2) -> DataFrame:
    """The documents, all columns, with one row of each group of near-duplicates: that of the least id, then text hash.

    Ids and text hashes name rows, so rows of one id and different texts are told apart; of rows that are
    alike in both, one stays. Null ids come first.
    """
    th = _text_hash()
    named = docs.select(F.struct("doc_id", th.alias("th")).alias("doc_id"), "text")
    rows = near_duplicates(named, k, most)
    heads = materialise(rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.*").groupBy("doc_id", "th").agg(F.count("*").alias("n")))
    return _only(docs, heads)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _only(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The documents that heads (doc_id, th, n: rows alike in both) name, once each."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(F.col("doc_id").alias("id"), _text_hash().alias("text_hash"), row)
    keys = heads.select("doc_id", "th")
    out = named.join(keys, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("th")), "left_semi")
    if not heads.where("n > 1").isEmpty():
        out = out.dropDuplicates(["id", "text_hash"])
    return out.select("row.*")


def _text_key(h: np.ndarray) -> int:
    """Hash of a text's words in their order."""
    place = _mix(np.arange(7, len(h) + 7, dtype=np.uint64)) | np.uint64(1)
    return int(_mix((_mix(h) * place).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).view(np.int64)[0])


def _profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, ph, fp, keys): hash of the words, SimHash fingerprint of the shingles and keys of the bands of their minima; null and none under k words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        salt, factor = (x[:, None] for x in _factors(bands * rows))
        for batch in it:
            ph, fps, keys = [], [], []
            for text in batch.column(2):
                h = words((text.as_py() or "").encode("utf-8", "replace").lower().split())
                ph.append(_text_key(h))
                if len(h) < k:
                    fps.append(None)
                    keys.append(np.zeros(0, np.int64))
                    continue
                grams = np.unique(shingles(h, k))
                least, ones = np.full(bands * rows, ~np.uint64(0)), np.zeros(64, np.int64)
                for low in range(0, len(grams), 1 << 12):
                    part = grams[low : low + (1 << 12)]
                    least = np.minimum(least, ((part ^ salt) * factor).min(axis=1))
                    ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fps.append(int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0]))
                key = np.zeros(bands, np.uint64)
                for r in range(rows):
                    key = _mix(key * np.uint64(ORIGIN | 1) + _mix(least.reshape(bands, rows)[:, r]))
                keys.append((key * np.uint64(bands) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            listed = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ph, pa.int64()), pa.array(fps, pa.int64()), listed], ["doc_id", "th", "ph", "fp", "keys"])

    return docs.select("doc_id", _text_hash().alias("th"), "text").mapInArrow(give_back(batches), f"doc_id {kind}, th long, ph long, fp long, keys array<long>")


def _text_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(ph, s): distinct shingle hashes of the wanted texts (doc_id, th), one row for each hash of words."""
    named = docs.select("doc_id", _text_hash().alias("th"), "text")
    joined = named.join(wanted.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in it:
            ph, sets = [], []
            for text in batch.column(0):
                h = words((text.as_py() or "").encode("utf-8", "replace").lower().split())
                ph.append(_text_key(h))
                sets.append(np.unique(shingles(h, k)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ph, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["ph", "s"])

    return joined.select("text").mapInArrow(batches, "ph long, s array<long>").dropDuplicates(["ph"])


def keep_one_similar(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, recall: float = 0.999) -> DataFrame:
    """The documents, all columns, with one row of each group of texts whose sets of k-word shingles are similar.

    Two texts are linked if their words are equal, or if the Jaccard index of their sets is at least `similarity`, which
    is tested exactly. Candidates are texts whose SimHash fingerprints differ in at most two bits, or are connected by such, found by
    close_pairs with its table of distances to references, and texts that share a band of minima: at a similarity of 0.8
    fingerprints differ in about ten of 64 bits, where no table of distances tells anything apart, while bands find a pair with
    chance `recall`. A group is a connected component; its least id, then text hash, stays, as in keep_one_each.
    """
    bands, rows = tune_bands(similarity, recall)
    named = materialise(_profiles(docs, k, bands, rows))
    nodes = named.groupBy("ph").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialise(nodes)
    near = components(close_pairs(nodes.where("fp IS NOT NULL").select("fp").distinct()))
    # one row a text: those of one component of fingerprints meet under its name
    close = nodes.where("fp IS NOT NULL").join(near, F.col("fp") == F.col("node"), "left").select("ph", "n", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"))
    keyed = nodes.select("ph", "n", F.explode("keys").alias("key")).union(close)
    twice = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    colliding = materialise(keyed.join(twice, "key", "left_semi"))
    wanted = nodes.select("ph", "one.*").join(colliding.select("ph").distinct(), "ph", "left_semi")
    sets = materialise(_text_sets(docs, wanted, k))
    links = close_links(colliding, sets, similarity)
    drop_table(colliding)
    drop_table(sets)
    reach = components(links)
    classes = nodes.join(reach, nodes.ph == reach.node, "left").select("one", F.coalesce("component", "ph").alias("c"))
    best = classes.groupBy("c").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_t"))
    rows_of = named.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    heads = materialise(rows_of.join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi"))
    return _only(docs, heads)
