"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.llm.common import give_back

WINDOW = 5
#: Windows of the benchmark up to which their hashes go to every task, 8 bytes each; beyond, documents' windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
LEAST_LITERALS = 2
#: Tokens by which a short item's windows may be out of place in one occurrence; for long items half their size.
DRIFT = 8

# Number words and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters dollar dollars cent cents euro euros percent mph kph degrees".split())

_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_MEASURE = re.compile(r"([$€£+-]?\d[\d.,]*)([a-z]{1,3})")
_BREAK = "\ue000"  # stands for a line's end among the tokens
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Canon:
    """Tokens to template symbols: literals, or one of the typed placeholders <num>, <unit> and <name>.

    A word in title case is a name; where it begins a sentence or a line it may be one, so a text has several readings: such
    words as literals, such words as names, and no names at all. Texts are compared in all of them. Punctuation
    around words goes and case is folded, so that reformatted text has the same templates.
    """

    SLOTS = tuple(xxhash.xxh64_intdigest(x, 7) for x in ("<num>", "<unit>", "<name>"))
    LIMIT = 200_000  # tokens kept, about 40 MB

    def __init__(self):
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.fresh: list[tuple[int, int, int, int, int]] = []  # kept, ends a sentence, symbol, symbol as a name, value
        self.marks, self.table, self.filled = np.zeros((2, 1024), bool), np.zeros((3, 1024), np.uint64), 0

    def _learn(self, token: str) -> int:
        body = _EDGE.sub("", token)
        ends = token.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":", _BREAK)
        low = body.lower()
        num, unit, name = self.SLOTS
        if not body:
            row = (0, int(ends), 0, 0, 0)
        elif _NUMBER.fullmatch(low) or low in NUMBER_WORDS or ((m := _MEASURE.fullmatch(low)) and m[2] in UNITS):
            row = (1, int(ends), num, num, xxhash.xxh64_intdigest(low, 7))
        elif low in UNITS:
            row = (1, int(ends), unit, unit, xxhash.xxh64_intdigest(low, 7))
        else:
            h = xxhash.xxh64_intdigest(low, 7)
            row = (1, int(ends), h, name if body[:1].isupper() and not body[1:].isupper() and len(body) > 1 else h, h)
        self.fresh.append(row)
        self.known[token] = n = self.filled + len(self.fresh) - 1
        return n

    def readings(self, text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str]]:
        """Symbols of the kept tokens in each reading, their values, their places among the raw tokens, and the raw tokens.

        Readings are one, where no word is in title case, or three: names only inside sentences, everywhere, nowhere.
        """
        if self.filled > self.LIMIT:
            self._forget()
        tokens = text.replace("\n", f" {_BREAK} ").split()
        get, learn = self.known.get, self._learn
        ids = np.fromiter([i if (i := get(t)) is not None else learn(t) for t in tokens], np.int64, len(tokens))
        self._grow()
        kept, ends = self.marks[0][ids], self.marks[1][ids]
        tell = np.flatnonzero(kept | ends)  # a token that is dropped says nothing unless a sentence ends with it
        after = np.concatenate([[True], ends[tell[:-1]]]) if len(tell) else np.zeros(0, bool)
        place = tell[kept[tell]]
        first = after[kept[tell]]
        held = ids[place]
        folded, named, value = self.table[0][held], self.table[1][held], self.table[2][held]
        reads = [np.where(first, folded, named), named, folded] if (folded != named).any() else [folded]
        return reads, value, place, tokens

    def _grow(self):
        need = self.filled + len(self.fresh)
        while need > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)], axis=1)
        if need > self.filled:
            fresh = np.array(self.fresh, np.uint64).T
            self.fresh = []
            self.marks[:, self.filled : need] = fresh[:2] == 1
            self.table[:, self.filled : need] = fresh[2:]
            self.filled = need

    def windows(self, symbol: np.ndarray, k: int) -> np.ndarray:
        """Hash of each window of k symbols."""
        n = len(symbol) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, power = symbol[:n].copy(), 1
        for j in range(1, k):
            power = power * _MIX & _MASK
            h += symbol[j : j + n] * np.uint64(power)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _windows(df: DataFrame, id_col: str, wanted, k: int, lengths: list[int] | None = None) -> DataFrame:
    """(id, th, pos, h, slots, total, size): windows of items (`lengths` is None) or of documents, in all readings.

    th: hash of the text; slots: values of the placeholders, in order. An item's windows are those with enough literals where
    title case makes names everywhere; without any, where it does inside sentences, and then where it makes none.
    An item that has none at all, as it is too short or holds little but slots, has windows of the values themselves, of size k
    or of the whole sequence. Of documents come the windows whose hash is wanted (all, if None), with windows
    of values for the sizes in `lengths`; of those under k, the first place of each.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, keys = Canon(), None
        if wanted is not None:
            keys = wanted.value
            hint = np.zeros(1 << 20, bool)
            hint[(keys >> np.uint64(44)).astype(np.int64)] = True
        slot_ids = set(Canon.SLOTS)

        def among(h: np.ndarray) -> np.ndarray:
            if keys is None:
                return np.arange(len(h))
            at = np.flatnonzero(hint[h >> np.uint64(44)])
            return at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]] if len(at) else at

        def values(value: np.ndarray, m: int) -> np.ndarray:
            return canon.windows(value, m) ^ np.uint64((m + 1) * _MIX & _MASK)

        for batch in it:
            row, pos, hashes, slots, total, size = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                reads, value, place, tokens = canon.readings(text.as_py() or "")
                spots, plain = [], []
                for symbol in reads:
                    h = canon.windows(symbol, k)
                    at = among(h)
                    # windows of placeholders alone would tie unrelated texts together
                    literal = [sum(int(x) not in slot_ids for x in symbol[p : p + k]) for p in at.tolist()]
                    spots.append((symbol, h, at[np.array(literal, np.int64) >= LEAST_LITERALS] if len(at) else at))
                of = 0
                if lengths is None:
                    order = (1, 0, 2) if len(spots) > 1 else (0,)
                    own = next((spots[r][2] for r in order if len(spots[r][2])), None)
                    if own is not None:
                        spots, of = [(symbol, h, at[np.isin(at, own)]) for symbol, h, at in spots], len(own)
                    elif len(value):
                        h = values(value, min(k, len(value)))
                        plain, of = [(min(k, len(value)), h, np.arange(len(h)))], len(h)
                else:
                    for m in lengths:
                        h = values(value, m)
                        at = among(h)
                        plain.append((m, h, at if m == k else at[np.unique(h[at], return_index=True)[1]]))
                seen = set()
                for symbol, h, at in spots:
                    for p in at.tolist():
                        if (p, int(h[p])) in seen:
                            continue
                        seen.add((p, int(h[p])))
                        row.append(i)
                        pos.append(p)
                        hashes.append(int(h[p].view(np.int64)))
                        slots.append([_EDGE.sub("", tokens[place[q]]).lower() for q in range(p, p + k) if int(symbol[q]) in slot_ids])
                        total.append(of)
                        size.append(0)
                for m, h, at in plain:
                    row += [i] * len(at)
                    pos += at.tolist()
                    hashes += h[at].view(np.int64).tolist()
                    slots += [[] for _ in at]
                    total += [of] * len(at)
                    size += [m] * len(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 2)), pa.array(pos, pa.int32()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(total, pa.int32()), pa.array(size, pa.int32())],
                ["id", "th", "pos", "h", "slots", "total", "size"],
            )

    return df.select(id_col, "text", F.xxhash64("text")).mapInArrow(give_back(batches), f"id {kind}, th long, pos int, h long, slots array<string>, total int, size int")


def template_matches(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW) -> DataFrame:
    """For each occurrence of an item in a document: matched and total windows of the item, slots and consistent slots.

    Documents' windows are first held against the hashes of the benchmark's, where those are few enough to go to
    every task, and then hash-joined with them. Hits with the same offset (place in the document minus place in the
    item) are one candidate occurrence; so are those in two neighbouring bins of offsets, of half the item's size or DRIFT, for
    copies with words put in or left out. There, each window of the item has one hit, the nearest to the commonest offset. A
    slot value of the item is consistent if all its places in the item stand for one value in the occurrence.
    """
    spark = docs.sparkSession
    items = _windows(benchmark.where("item_id IS NOT NULL"), "item_id", None, k).selectExpr("id AS item_id", "pos AS item_pos", "h AS item_h", "slots AS item_slots", "total", "size")
    keys = items.select("item_h").distinct()
    wanted = None
    n, lengths = items.agg(F.count("*"), F.collect_set(F.when(F.col("size") > 0, F.col("size")))).first()
    if n <= BROADCAST_WINDOWS:
        got = keys.toArrow().column(0).to_numpy().view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(got) if len(got) else np.zeros(1, np.uint64))
    found = _windows(docs, "doc_id", wanted, k, sorted(lengths)).selectExpr("id AS doc_id", "th", "pos", "h", "slots")
    hits = found.join(items, found.h == items.item_h).groupBy("doc_id", "th", "item_id", "pos", "item_pos")
    hits = hits.agg(F.first("total").alias("windows"), F.min(F.struct(F.size("slots").alias("n"), "slots", "item_slots")).alias("v"))
    hits = hits.withColumn("offset", F.col("pos") - F.col("item_pos"))
    at = F.floor(F.col("offset") / F.greatest(F.lit(DRIFT), F.ceil(F.col("windows") / 2)))
    bins = [F.struct(F.lit(wide).alias("wide"), bin.cast("long").alias("bin")) for wide, bin in ((False, F.col("offset")), (True, at), (True, at + 1))]
    group = ["doc_id", "th", "item_id", "wide", "bin"]
    # a bin has few offsets and an item few windows, so that groups are small however long a document is
    hits = hits.select("*", F.inline(F.array(*bins))).repartition(*group)
    hits = hits.withColumn("_c", F.count("*").over(Window.partitionBy(*group, "offset")))
    hits = hits.withColumn("_top", F.max(F.struct("_c", (-F.col("offset")).alias("o"))).over(Window.partitionBy(*group)))
    nearest = Window.partitionBy(*group, "item_pos").orderBy(F.abs(F.col("offset") + F.col("_top.o")), "pos")
    hits = hits.withColumn("_r", F.row_number().over(nearest)).where("_r = 1")
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("v.slots").alias("slots"), F.col("v.item_slots").alias("item_slots")))))
    out = hits.groupBy(*group).agg(F.count("*").alias("matched"), F.first("windows").alias("windows"), F.min("pos").alias("first_pos"), pairs.alias("_p"))
    out = out.withColumn("_n", F.array_distinct(F.col("_p.item_slots")))
    one = F.filter("_n", lambda n: F.size(F.filter("_p", lambda p: p["item_slots"] == n)) == 1)
    same = F.filter(one, lambda n: F.exists("_p", lambda p: (p["item_slots"] == n) & (p["slots"] == n)))
    return out.select("doc_id", "th", "item_id", "matched", "windows", "first_pos", *[F.size(x).cast("long").alias(name) for x, name in ((F.col("_n"), "slots"), (one, "consistent"), (same, "same"))])


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float, k: int) -> DataFrame:
    m = template_matches(docs, benchmark, k).withColumn("coverage", F.col("matched") / F.col("windows"))
    return m.where((F.col("coverage") >= similarity) & (F.col("consistent") >= similarity * F.col("slots")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, k: int = WINDOW) -> DataFrame:
    """The documents, all columns, that hold no benchmark item.

    A row is told by its id and its text's hash, so of rows that share an id, or have none, only those that hold an item go.
    """
    held = _found(docs, benchmark, similarity, k).select(F.col("doc_id").alias("d"), "th").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), row)
    return named.join(held, F.col("id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("th")), "left_anti").select("row.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, k: int = WINDOW) -> DataFrame:
    """Pairs (doc_id, item_id, matched, windows, coverage, slots, consistent, verbatim, first_pos) where the document holds the item.

    It does if one occurrence has at least `similarity` of the item's windows and as large a share of the
    item's slot values is consistent in it; verbatim: every slot has the item's own value. Figures are those of one occurrence, a
    verbatim one if there is any, then the one with the most windows. An item
    that is too short for a window is held where all its words stand together. Documents and items with null or
    empty text are in no pair; repeated rows count once.
    """
    m = _found(docs, benchmark, similarity, k)
    m = m.withColumn("verbatim", F.col("same") == F.col("slots"))
    rank = F.struct("verbatim", "matched", (-F.col("first_pos")).alias("o"), "consistent", "slots")
    best = F.max_by(F.struct("matched", "windows", "coverage", "slots", "consistent", "verbatim", "first_pos"), rank)
    return m.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", "_b.*")
