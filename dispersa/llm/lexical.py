"""Ranked lexical search by sequential reads of impact-sorted lists with score intervals, without random access."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.llm.common import drop_table, give_back, materialise

#: A term byte stays, A-Z become lower-case, all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Buckets of the bit map that tells which terms may occur in an item: 128 KB at any number of items.
MARKS = 1 << 20

#: Impacts of one band differ by less than 2^13 of 10^6: the grain in which lists are read.
BAND_BITS = 13

#: Postings of an item that the first round reads, and how much deeper each further round goes.
FIRST_READ, DEEPER = 4000, 4


def _terms(batches: Iterator[pa.RecordBatch], marks: bytes | None) -> Iterator[pa.RecordBatch]:
    """Terms and their numbers, for each text; only those that `marks` may hold, if it is given."""
    for batch in batches:
        n, same, sizes, terms, times = [], [], [], [], []
        for text in batch.column("text"):
            found = (text.as_py() or "").encode().translate(_FOLD).split()
            n.append(len(found))
            counted = Counter(found)
            if marks is not None:
                kept = [(t, c) for t, c in counted.items() if marks[(h := zlib.crc32(t) & (MARKS - 1)) >> 3] >> (h & 7) & 1]
            else:
                kept = list(counted.items())
            kept.sort()
            same.append(hashlib.md5(b"%d" % len(found) + b"".join(b" %b %d" % x for x in kept)).digest())
            sizes.append(len(kept))
            terms += [t for t, _ in kept]
            times += [c for _, c in kept]
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), *lists], names=["id", "n", "same", "terms", "times"])


def term_table(rows: DataFrame, key: str, text: str = "text", marks: bytes | None = None) -> DataFrame:
    """(id, n, same, terms, times, row) of each row: its number of terms, a digest of what scores depend on, its distinct terms."""
    kind = dict(rows.dtypes)[key]
    found = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        give_back(lambda it: _terms(it, marks)), f"id {kind}, n long, same binary, terms array<string>, times array<long>"
    )
    return materialise(found.withColumn("row", F.monotonically_increasing_id()))


def _marks(words: DataFrame) -> bytes:
    """Bit map of the hashes of all words, at most MARKS bits."""
    bucket = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(MARKS - 1))
    cells = words.select(bucket.alias("h")).groupBy(F.shiftright("h", 3).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, int(h & 7))")).alias("bits"))
    out = bytearray(MARKS >> 3)
    for cell, bits in cells.collect():
        out[cell] = bits
    return bytes(out)


def _lists(postings: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """(q, tid, weight, band, best, before) of each item's bands: the highest gain in it and the postings before it, best first."""
    bands = postings.groupBy("tid", "band").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.sum("copies").alias("docs"))
    bands = materialise(bands)
    df = bands.groupBy("tid").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = wanted.join(df, "tid").withColumn("weight", weight * F.col("times")).where("weight > 0").select("q", "tid", "weight")
    best = weighted.join(bands, "tid").withColumn("best", F.col("weight") * F.col("top"))
    ahead = Window.partitionBy("q").orderBy(F.desc("best"), "tid").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(best.select("q", "tid", "weight", "band", "best", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")))


def _bounds(postings: DataFrame, cuts: DataFrame, left: DataFrame) -> DataFrame:
    """(q, class, copies, low, high) of all classes met in the parts of lists that were read."""
    read = cuts.where("cut IS NOT NULL")
    least = read.agg(F.min("cut")).first()[0]
    met = postings.where(F.col("band") >= F.lit(0 if least is None else least)).join(read, "tid").where("band >= cut")
    met = met.groupBy("q", "class").agg(F.max("copies").alias("copies"), F.sum(F.col("weight") * F.col("impact")).alias("low"), F.sum("ceiling").alias("seen"))
    return met.join(left, "q").select("q", "class", "copies", "low", (F.col("low") + F.col("ceilings") - F.col("seen")).alias("high"))


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th highest lower bound of a document, 0 where fewer are known."""
    order = Window.partitionBy("q").orderBy(F.desc("low"), "class")
    first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    reached = first.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= k)
    return reached.groupBy("q").agg(F.max("low").alias("kth"))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_key: str = "doc_id", item_key: str = "item_id", first_read: int = FIRST_READ) -> DataFrame:
    """The k best documents of each item: (item_key, rank, doc_key, score), as the terms' integer weights and impacts score them.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A document's impact for a term depends on the
    term's occurrences and the document's length alone, so a term's list is sorted by impact once, in bands, within each file of
    the index. Rounds read an item's lists from the highest gain down. What was read gives each document a lower score; what the
    unread rest of the lists it wasn't met in could still add gives the upper one. An item is closed once no document outside
    what was met can reach the k-th lower score; then the rest of its lists is read for the remaining candidates only, unless all
    their intervals are points already. Documents of equal length and equal query terms are one class, so copies are read once.

    Null texts and texts without a term are in no result and in no count; an item without a term or without a match has no row. Each
    row of `docs` is a document, rows of equal ids too. Equal scores rank by ascending id, null ids last. A repeated row of `items`
    counts once; an item id with several texts is an item a text. Other columns are ignored. Texts are read whole.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(f"`{item_key}`"), F.col("text").cast("string").alias("text")).distinct()
    asked = term_table(texts, item_key)
    words = asked.select(F.col("row").alias("q"), F.explode(F.arrays_zip("terms", "times")).alias("x")).select("q", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    vocabulary = materialise(words.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    wanted = words.join(vocabulary, "term").select("q", "tid", "times")
    parts = term_table(docs, doc_key, marks=_marks(vocabulary))
    known = parts.where("n > 0")
    n_docs, n_terms = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    classes = known.groupBy("same", "n").agg(F.min("row").alias("class"), F.count("*").alias("copies"))
    leaders = known.where(F.size("terms") > 0).join(classes.select(F.col("class").alias("row"), "copies"), "row")
    each = leaders.select(F.col("row").alias("class"), "copies", "n", F.explode(F.arrays_zip("terms", "times")).alias("x"))
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    each = each.select("class", "copies", m.alias("m"), F.col("x.terms").alias("term"), F.col("x.times").alias("tf")).join(vocabulary, "term")
    each = each.withColumn("impact", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)"))
    banded = each.select("tid", F.shiftright("impact", BAND_BITS).cast("int").alias("band"), "impact", "class", "copies")
    postings = materialise(banded.sortWithinPartitions(F.desc("band"), "tid", F.desc("impact")))
    lists = _lists(postings, wanted, n_docs)

    depth, opened, closed = first_read, lists.select("q").distinct(), []
    while not opened.isEmpty():
        own = lists.join(opened, "q", "left_semi")
        read = F.col("before") < depth
        cuts = materialise(own.groupBy("q", "tid").agg(F.max("weight").alias("weight"), F.min(F.when(read, F.col("band"))).alias("cut"), F.coalesce(F.max(F.when(~read, F.col("best"))), F.lit(0)).alias("ceiling")))
        left = cuts.groupBy("q").agg(F.sum("ceiling").alias("ceilings"))
        bounds = materialise(_bounds(postings, cuts, left))
        state = materialise(left.join(_kth(bounds, k), "q", "left").select("q", F.coalesce("kth", F.lit(0)).alias("kth"), (F.expr("ceilings = 0 OR ceilings < coalesce(kth, 0)")).alias("done")))
        done = state.where("done")
        stay = materialise(bounds.join(done.select("q", "kth"), "q").where("high >= kth").select("q", "class", "low", "high"))
        closed.append(_resolved(postings, cuts, stay))
        drop_table(bounds)
        opened = state.where("NOT done").select("q")
        depth *= DEEPER
    if not closed:
        kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
        return spark.createDataFrame([], f"`{item_key}` {kinds[1]}, rank int, `{doc_key}` {kinds[0]}, score long")
    scores = closed[0]
    for more in closed[1:]:
        scores = scores.union(more)
    return _documents(materialise(scores), known, classes, asked, k, doc_key, item_key)


def _resolved(postings: DataFrame, cuts: DataFrame, stay: DataFrame) -> DataFrame:
    """(q, class, score): the candidates' final scores, from the rest of the lists unless no interval is open."""
    if stay.where("low < high").isEmpty():
        return stay.select("q", "class", F.col("low").alias("score"))
    below = cuts.select("q", "tid", "weight", F.coalesce("cut", F.lit(1 << (20 - BAND_BITS))).alias("cut")).where("ceiling > 0")
    vague = stay.where("low < high").select("q", "class")
    rest = postings.select("tid", "band", "impact", "class").join(vague, "class").join(below, ["q", "tid"]).where("band < cut")
    more = rest.groupBy("q", "class").agg(F.sum(F.col("weight") * F.col("impact")).alias("more"))
    return stay.join(more, ["q", "class"], "left").select("q", "class", (F.col("low") + F.coalesce("more", F.lit(0))).alias("score"))


def _documents(scores: DataFrame, known: DataFrame, classes: DataFrame, asked: DataFrame, k: int, doc_key: str, item_key: str) -> DataFrame:
    """The k best rows of each item, classes read as the documents that they stand for."""
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    best = scores.where("score > 0").withColumn("r", F.rank().over(order)).where(F.col("r") <= k).drop("r")
    members = known.join(classes.select("same", "n", "class"), ["same", "n"]).select("class", "id")
    members = members.join(best.select("class").distinct(), "class", "left_semi")
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.asc_nulls_last("id")))).where(F.col("r") <= k)
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.join(few.select("class", "id"), "class").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("q"), F.col("id").alias("_item"))
    return ranked.join(named, "q").select(F.col("_item").alias(item_key), "rank", F.col("id").alias(doc_key), "score")
