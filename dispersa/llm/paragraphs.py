"""Paragraph near-duplicates by MinHash banding, verified and clustered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import components, drop_table, give_back, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Paragraphs are blocks of SHORT words, told apart exactly, blocks of LONG words, which are linked if similar, and whole texts of
#: fewer words, linked likewise. A block begins where a word's hash is the least within REACH words to both sides, a short one
#: at a text's begin as well. Two long blocks of a text begin so far apart that what they share can't make them similar.
SHORT, SHORT_REACH = 12, 5
LONG, LONG_REACH = 60, 30
#: Words of texts that are worked on together.
PIECE_WORDS = 200_000
#: Colliding paragraphs of a bucket up to which all its pairs are verified; for larger buckets see close_links().
BUCKET = 24
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tune_bands(similarity: float, recall: float = 0.999, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` minima that a pair at `similarity` collides in with chance >= recall."""
    miss = 1 - similarity**rows
    return int(np.ceil(np.log(1 - recall) / np.log(miss))), rows


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(10))
    return rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


class Words:
    """Hashes of lower-cased words, the lower half of their md5; a bounded table keeps those seen."""

    LIMIT = 150_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.md5(w).digest()[8:], "little")
            out.append(h)
        return np.array(out, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(h) - k + 1
    out, power = np.zeros(max(0, n), np.uint64), 1
    for j in range(k):
        out += h[j : j + max(0, n)] * np.uint64(power)
        power = power * _ODD & _MASK
    return _mix(out)


def anchors(h: np.ndarray, own: np.ndarray, reach: int) -> np.ndarray:
    """Where a word's hash is less than those of the `reach` words before it and no more than those after it, in its text."""
    out = np.ones(len(h), bool)
    for d in range(1, min(reach, len(h) - 1) + 1):
        same = own[d:] == own[:-d]
        out[d:] &= ~same | (h[d:] < h[:-d])
        out[:-d] &= ~same | (h[:-d] <= h[d:])
    return out


def blocks(h: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, int, bool]]:
    """(first words, size, linked if similar) of the paragraphs of texts whose words' hashes follow each other."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    left = (begin + sizes)[own] - np.arange(len(h))  # words to the text's end
    short = anchors(h, own, SHORT_REACH)
    short[begin[sizes > 0]] = True  # so that equal texts are found whatever their size
    out = [(np.flatnonzero(at & (left >= size)), size, size == LONG) for size, at in ((SHORT, short), (LONG, anchors(h, own, LONG_REACH)))]
    whole = [(begin[sizes == size], size, size >= SHINGLE) for size in np.unique(sizes[sizes < LONG]).tolist()]
    return [*out, *whole]


def block_keys(mixed: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words of each block, in their order; `mixed`: the words' hashes, mixed."""
    place = _mix(np.arange(7, size + 7, dtype=np.uint64)) | np.uint64(1)
    out = np.full(len(first), size, np.uint64)
    for j in range(size):
        out += mixed[first + j] * place[j]
    return _mix(out)


def _band_keys(grams: np.ndarray, first: np.ndarray, size: int, bands: int, rows: int) -> np.ndarray:
    """(blocks x bands): keys of the bands of minima over the shingles of blocks of a size."""
    salt, factor = _factors(bands * rows)
    ends = np.stack([first, first + size - SHINGLE + 1], axis=1).ravel()
    key = np.zeros((bands, len(first)), np.uint64)
    grams = np.concatenate([grams, np.zeros(1, np.uint64)])  # ends may be one beyond the last
    for n, (s, f) in enumerate(zip(salt, factor, strict=True)):
        least = np.minimum.reduceat((grams ^ s) * f, ends)[::2] if len(first) else np.zeros(0, np.uint64)
        key[n // rows] = _mix(key[n // rows] * np.uint64(_ODD) + _mix(least))
    return (key * np.uint64(bands) + np.arange(bands, dtype=np.uint64)[:, None]).T


def _split(text: str | None) -> list[bytes]:
    """Words with ASCII letters lower-cased; null text: none."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _occurrences(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, start, words, ph, bands): each paragraph with the hash of its words, and the band keys of those linked if similar; th: hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def made(batch: pa.RecordBatch, row: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in hashes])
            h = np.concatenate(hashes)
            own = np.repeat(np.arange(len(sizes)), sizes)
            begin = (np.cumsum(sizes) - sizes)[own]
            mixed = _mix(h)
            at, start, size, ph, keys, held = [], [], [], [], [], []
            grams = shingles(h)
            for first, n, banded in blocks(h, sizes):
                at.append(np.array(row, np.int64)[own[first]])
                start.append(first - begin[first])
                size.append(np.full(len(first), n))
                ph.append(block_keys(mixed, first, n))
                held.append(np.full(len(first), bands if banded else 0))
                if banded:
                    keys.append(_band_keys(grams, first, n, bands, rows).ravel())
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
            at, held = pa.array(np.concatenate(at)), np.concatenate(held)
            offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), mask=pa.array(held == 0))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), flat(start), flat(size), pa.array(np.concatenate(ph).view(np.int64)), listed],
                ["doc_id", "th", "start", "words", "ph", "bands"],
            )

        for batch in it:
            row, hashes, total = [], [], 0
            for i, text in enumerate(batch.column(1)):
                own = _split(text.as_py())
                if not own:
                    continue
                row.append(i)
                hashes.append(words(own))
                total += len(own)
                if total > PIECE_WORDS:
                    yield made(batch, row, hashes)
                    row, hashes, total = [], [], 0
            if row:
                yield made(batch, row, hashes)

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(give_back(batches), f"doc_id {kind}, th long, start int, words int, ph long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ph, s): distinct shingle hashes of the wanted paragraphs (doc_id, th, start, words, ph), read from one text of each.

    Ids may be null or repeated: a row's text is told by its hash as well, and a block counts only if its words have the wanted hash.
    """
    lists = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("start", "words", "ph")).alias("w"))
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    joined = named.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("text", "w")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in it:
            ph, sets = [], []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                h = words(_split(text.as_py()))
                for w in want:
                    n = w["words"]
                    own = h[w["start"] : w["start"] + n]
                    if len(own) == n and int(block_keys(_mix(own), np.zeros(1, np.int64), n).view(np.int64)[0]) == w["ph"]:
                        ph.append(w["ph"])
                        sets.append(np.unique(shingles(own)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ph, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["ph", "s"])

    return joined.mapInArrow(batches, "ph long, s array<long>").dropDuplicates(["ph"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets' Jaccard index is at least `similarity`."""
    a, b = sets.select(F.col("ph").alias("a"), F.col("s").alias("sa")), sets.select(F.col("ph").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
    both = both.where(F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb")))
    both = both.withColumn("_i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("_i") >= similarity * (F.size("sa") + F.size("sb") - F.col("_i"))).select("a", "b")


#: Marks of a set of numbers are this many columns of 64 bits.
MARKS = 4


def _marks(numbers: Column, name: str, shift: int = 0) -> list[Column]:
    """64 * MARKS bits as columns, set at the numbers' remainders after `shift` bits go: at least as many numbers as bits."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    places = F.transform(numbers, lambda x: F.pmod(F.shiftright(x, shift), F.lit(64 * MARKS)).cast("int"))
    bits = lambda j: F.filter(places, lambda p: F.floor(p / 64) == j)
    return [F.aggregate(bits(j), zero, lambda a, p: a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(p, F.lit(64))))).alias(f"{name}{j}_") for j in range(MARKS)]


def _bits(x: str, y: str, join: Callable[[Column, Column], Column]) -> Column:
    """Number of bits of two sides' marks, joined column by column."""
    return sum((F.bit_count(join(F.col(x.format(j)), F.col(y.format(j)))) for j in range(1, MARKS)), F.bit_count(join(F.col(x.format(0)), F.col(y.format(0)))))


def _rest_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs among members (lead, ph, c) with one leader and different components, by prefix and positional filtering.

    A member's shingles are ordered with those its leader lacks first. Two sets of at least that similarity share one of the
    first |s| - ceil(similarity |s|) + 1 shingles of each, and from the first that they share on, enough must be left in both.
    What two sets share is at most the leader's shingles that neither lacks, and shingles of their own if those can be
    the same; marks of lacking shingles, by their places among the leader's (exact up to 64 * MARKS), and two of own ones bound both. No filter loses a pair. Edited copies of
    one source mostly have shingles of their own and lack others, so large families give few candidates.
    """
    lead = sets.select(F.col("ph").alias("lead"), F.col("s").alias("so"))
    one = members.join(sets, "ph").join(lead, "lead")
    ordered = F.concat(F.array_sort(F.array_except("s", "so")), F.array_sort(F.array_intersect("s", "so")))
    own = F.array_except("s", "so")
    lacks = F.filter(F.sequence(F.lit(0).cast("long"), F.size("so").cast("long") - 1), lambda i: ~F.array_contains("s", F.col("so")[i.cast("int")]))
    one = one.select("lead", "ph", "c", F.size("s").alias("n"), F.size("so").alias("m"), F.size(own).alias("k"), *_marks(own, "own"), *_marks(own, "own2", 8), *_marks(lacks, "lacks"), ordered.alias("o"))
    marks = [c for c in one.columns if c.endswith("_")]
    first = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1)
    prefix = materialise(one.select("lead", "ph", "c", "n", "m", "k", *marks, F.posexplode(first).alias("i", "g")))
    names = ("ph", "c", "n", "m", "k", *marks, "i")
    left, right = prefix.withColumnsRenamed({x: f"{x}a" for x in names}), prefix.withColumnsRenamed({x: f"{x}b" for x in names})
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))  # i counts from 0, so this holds the shared one
    # a set bit of one side's own shingles that the other side lacks stands for a shingle without a partner there
    alone = lambda x, y: _bits(x, y, lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
    sides = [("ka", f"{name}{{}}_a", f"{name}{{}}_b") for name in ("own", "own2")] + [("kb", f"{name}{{}}_b", f"{name}{{}}_a") for name in ("own", "own2")]
    partners = F.least(*[F.col(k) - alone(x, y) for k, x, y in sides])
    both = partners + F.col("ma") - _bits("lacks{}_a", "lacks{}_b", lambda p, q: p.bitwiseOR(q))
    enough = F.least(room, both) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = left.join(right, ["lead", "g"]).where((F.col("pha") < F.col("phb")) & (F.col("ca") != F.col("cb")) & enough)
    return pairs.select(F.col("pha").alias("a"), F.col("phb").alias("b"))


def close_links(colliding: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect all colliding paragraphs (key, ph, n) of at least that similarity.

    Buckets of up to BUCKET members have all pairs verified. In a larger one, the member with the most copies leads: it is
    verified against all others, as the source of a family of edited copies mostly is, and members that are in
    different components after that are paired by _rest_pairs.
    """
    sizes = colliding.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("n", "ph")).alias("top"))
    colliding = materialise(colliding.join(sizes.select("key", "size", F.col("top.ph").alias("lead")), "key"))
    small = colliding.where(F.col("size") <= BUCKET)
    pairs = small.select("key", F.col("ph").alias("a")).join(small.select("key", F.col("ph").alias("b")), "key").where("a < b").select("a", "b")
    members = materialise(colliding.where(F.col("size") > BUCKET).select("lead", "ph").distinct())
    stars = members.where("lead <> ph").select(F.least("lead", "ph").alias("a"), F.greatest("lead", "ph").alias("b"))
    links = materialise(_verified(pairs.union(stars), sets, similarity))
    drop_table(colliding)
    if members.isEmpty():
        return links
    named = members.join(components(links), F.col("ph") == F.col("node"), "left").select("lead", "ph", F.coalesce("component", "ph").alias("c"))
    named = materialise(named)
    spread = materialise(named.groupBy("lead").agg(F.min("c").alias("_l"), F.max("c").alias("_m")).where("_l <> _m").select("lead"))
    if spread.isEmpty():
        return links
    rest = _verified(_rest_pairs(named.join(spread, "lead", "left_semi"), sets, similarity), sets, similarity)
    return materialise(links.union(rest))


def _clustered(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(doc_id, th, start, words, kept_doc_id, kept_start): all paragraphs that another one repeats, with the first of their cluster."""
    bands, rows = tune_bands(similarity, recall)
    occ = materialise(_occurrences(docs, bands, rows))
    place = F.struct("doc_id", "th", "start", "words")
    repeats = ~F.min(place).eqNullSafe(F.max(place))  # rows alike in id and text are one occurrence
    paras = occ.where("bands IS NOT NULL").groupBy("ph").agg(F.count("*").alias("n"), repeats.alias("repeats"), F.min(place).alias("one"), F.first("bands").alias("bands"))
    paras = materialise(paras)
    keyed = paras.select("ph", "n", F.explode("bands").alias("key"))
    twice = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    colliding = materialise(keyed.join(twice, "key", "left_semi"))
    wanted = paras.select("ph", "one.*").join(colliding.select("ph").distinct(), "ph", "left_semi")
    sets = materialise(_sets(docs, wanted))
    links = close_links(colliding, sets, similarity)
    drop_table(colliding)
    drop_table(sets)
    named = components(links).select(F.col("node").alias("ph"), F.col("component").alias("cluster"))
    several = paras.where("repeats").select("ph").join(named, "ph", "full").select("ph", F.coalesce("cluster", "ph").alias("cluster"))
    same = occ.where("bands IS NULL").groupBy("ph").agg(repeats.alias("repeats")).where("repeats").select("ph", F.col("ph").alias("cluster"))
    # a whole text of SHORT words is a paragraph of both kinds; its cluster is the lesser, that of its component
    named = several.union(same).groupBy("ph").agg(F.min("cluster").alias("cluster"))
    # a table of its own, so that a paragraph or cluster of very many copies can be split in both joins
    found = materialise(occ.drop("bands").join(named, "ph").drop("ph"))
    for table in (occ, paras, links):
        drop_table(table)
    heads = materialise(found.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("head")))
    return found.join(heads, "cluster").select("doc_id", "th", "start", "words", F.col("head.doc_id").alias("kept_doc_id"), F.col("head.start").alias("kept_start"))


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.999) -> DataFrame:
    """(doc_id, start, words, kept_doc_id, kept_start, removed): every paragraph that another one repeats, closely or exactly.

    Paragraphs are content-defined blocks of words, so that a passage yields the same ones wherever it stands, within a line as well: a block
    begins at a word whose hash is the least around it (see anchors) and has SHORT or LONG words. A passage of 25 words nearly always
    holds a whole short block. A text of fewer than LONG words is a paragraph as a whole, too. Short blocks are repeated if
    equal, and so are texts of fewer than five words; long blocks and other whole texts at a Jaccard index of at least `similarity` of their
    five-word shingles are linked, found by bands of minima with chance `recall` at that similarity and verified exactly. A cluster is a
    connected component of links, named by its first document and word; that one is kept. The others are removed if they have
    SHORT words or more: repeats of shorter texts are reported and stay. `start` counts words from 0. Null and empty texts have no
    paragraph. Rows alike in id and text are one.
    """
    rows = _clustered(docs, similarity, recall)
    first = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))
    long = [F.col(c).cast("long").alias(c) for c in ("start", "words")]
    return rows.select("doc_id", *long, "kept_doc_id", F.col("kept_start").cast("long").alias("kept_start"), (~first & (F.col("words") >= SHORT)).alias("removed")).distinct()


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the words in the spans and the white space behind them."""
    raw = text.encode("utf-8", "replace")
    edge = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for low, high in sorted((s["start"], s["start"] + s["words"]) for s in spans):
        if edge[high] > at:
            out.append(raw[at : max(at, edge[low])])
            at = edge[high]
    return b"".join([*out, raw[at:]]).decode("utf-8")


def remove_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.999) -> DataFrame:
    """The documents without the paragraphs that another one repeats and that aren't the first of their cluster; all columns stay.

    A row's paragraphs are found by its id and text, so rows of one id (or of none) are told apart; of rows
    alike in both, all lose the same. Null texts stay null.
    """
    gone = _clustered(docs, similarity, recall)
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))) & (F.col("words") >= SHORT))
    lists = gone.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), row)
    joined = whole.join(lists, F.col("id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("row", "spans")
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row = batch.column(0)
            columns = row.flatten()
            columns[at] = pa.array([_cut(t, s) if s else t for t, s in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in row.type])

    return joined.mapInArrow(batches, docs.schema)
