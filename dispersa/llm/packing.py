"""Shortest-pack-first packing over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import give_back, materialise

#: Texts are worked on in pieces of about PIECE bytes. Each of a worker's two tables of encoded words holds at most WORDS words and IDS ids.
PIECE, WORDS, IDS = 1 << 19, 400_000, 1_500_000
#: Slot rows up to BROADCAST_SLOTS (56 bytes each) go to every task, more are joined by a shuffle.
BROADCAST_SLOTS = 200_000
ROW = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"
_ODD = 0x9E3779B97F4A7C15
#: Classes of bytes: white space, ASCII letters, marks that stand apart from letters, all others.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(b".,;:!?")] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTable:
    """Hashes of words and the ids of each, in open addressing over numpy arrays; two words with one 64-bit hash are taken for one."""

    def __init__(self, words: int, ids: int):
        self.bits = max(4, (words + words // 4 - 1).bit_length())  # up to 80 % full
        self.most, self.n, self.used = words, 0, 0
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.first = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.int32)  # a word may have more ids than 16 bits count
        self.ids = np.zeros(min(ids, 1 << 16), np.uint32)
        self.room = ids

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(_ODD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it isn't held; hashes aren't 0."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), self._home(h)
        while len(left):
            held = self.key[at]
            hit = held == h[left]
            out[left[hit]] = at[hit]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def full(self, more: int) -> bool:
        return self.n + more > self.most or self.used > self.room

    def add(self, h: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new hashes with their ids, one word after the other."""
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids)), np.uint32)])
        self.ids[self.used : need] = ids
        first = self.used + np.cumsum(count) - count
        self.n, self.used = self.n + len(h), need
        left, at = np.arange(len(h)), self._home(h)
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = h[left[free]]
            mine = free & (self.key[at] == h[left])  # of several that found one slot free, one has it now
            self.first[at[mine]], self.count[at[mine]] = first[left[mine]], count[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.key) - 1)


class WordEncoder:
    """Texts to ids, word by word.

    This tokenizer drops white space and never joins text across it, so a text's ids are those of its words in
    turn. Words of ASCII letters and the marks .,;:!? alone are lower-cased and cut between letters and marks, as the
    tokenizer does; it folds and joins other characters in ways of its own, so all other words go to it as they are. Two tables
    keep what was encoded: when the new one is full it becomes the old one, and words met again move to the new one.
    """

    def __init__(self, tokenizer_file: str, words: int = WORDS, ids: int = IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.size = words, ids
        self.new, self.old = WordTable(words, ids), WordTable(1, 1)
        rng = np.random.Generator(np.random.Philox(5))
        self.code = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_ODD, -1, 1 << 64), np.uint64)]))

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with plain words lower-cased, begin and end of each word, its hash)."""
        kind = _CLASS[raw]
        space = kind == _SPACE
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return raw, begin, end, np.zeros(0, np.uint64)
        odd = np.logical_or.reduceat(kind == _OTHER, begin)  # to the next word's begin; white space isn't odd
        raw = raw.copy()
        plain = np.repeat(~odd, np.diff(np.concatenate([begin, [len(raw)]])))
        raw[begin[0] :][plain] = _LOWER[raw[begin[0] :][plain]]
        cut = np.zeros(len(raw), bool)
        cut[begin] = True
        inner = (kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1]
        cut[begin[0] + 1 :] |= inner[begin[0] :] & plain[1:]
        begin = np.flatnonzero(cut)
        after = np.concatenate([begin[1:], [len(raw)]])
        end = np.minimum(after, end[np.searchsorted(end, begin, side="right")])
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.up[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return raw, begin, end, h ^ (h >> np.uint64(29)) | np.uint64(1 << 63)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        """Put distinct words that the new table lacks into it, from the old one or by the tokenizer."""
        at = self.old.slots(h)
        count, ids = np.zeros(len(h), np.int64), [None] * len(h)
        for i in np.flatnonzero(at >= 0).tolist():
            first, n = self.old.first[at[i]], self.old.count[at[i]]
            ids[i], count[i] = self.old.ids[first : first + n], n
        for i in np.flatnonzero(at < 0).tolist():
            ids[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
            count[i] = len(ids[i])
        self.new.add(h, count, np.concatenate(ids))

    def piece(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the offsets, and how many each has. A word may not reach over an offset, so texts end with white space."""
        raw, begin, end, h = self._words(raw)
        own = np.searchsorted(offsets, begin, side="right") - 1
        lost = self.new.slots(h) < 0
        if lost.any():
            if self.new.full(int(lost.sum())):
                self.old, self.new = self.new, WordTable(max(self.size[0], len(h)), self.size[1])
                lost[:] = True
            lacks, which = np.unique(h[lost], return_index=True)
            which = np.flatnonzero(lost)[which]
            data = raw.tobytes()
            self._learn(lacks, [data[a:b].decode("utf-8", "replace") for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)])
        at = self.new.slots(h)
        count = self.new.count[at].astype(np.int64)
        first = self.new.first[at].astype(np.int64)
        total = np.cumsum(count)
        flat = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)
        return self.new.ids[flat], np.bincount(own, weights=count, minlength=len(offsets) - 1).astype(np.int64)

    def __call__(self, text: str) -> np.ndarray:
        """Ids of one text of any length."""
        data = text.encode("utf-8", "replace") + b" "
        out, low = [], 0
        while low < len(data):
            high = low + PIECE
            if high < len(data):  # a word of more than a piece stays whole
                back = max(data.rfind(s, low, high) for s in (b" ", b"\n"))
                high = back + 1 if back > low else next((i + 1 for i in range(high, len(data)) if data[i] in b" \n"), len(data))
            raw = np.frombuffer(data[low:high], np.uint8)
            out.append(self.piece(raw, np.array([0, len(raw)]))[0])
            low = high
        return np.concatenate(out)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0

        def solve() -> None:
            nonlocal size
            if group:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in group])])
                ids, n = self.piece(np.frombuffer(b"".join(group), np.uint8), offsets)
                out.extend(np.split(ids, np.cumsum(n)[:-1]))
            group.clear()
            size = 0

        for text in texts:
            if len(text) >= PIECE:
                solve()
                out.append(self(text))
                continue
            group.append(text.encode("utf-8", "replace") + b" ")
            size += len(group[-1])
            if size >= PIECE:
                solve()
        solve()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """The encoder of this Python worker: tasks that a worker runs in turn share its table."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 2, limit: int = 4096) -> DataFrame:
    """Whole pieces of `limit` ids and the rest of each document, with the crc32 of their ids.

    A null text is an empty one: a single piece with the end id. Repeated rows give repeated pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(tokenizer_file)
        end = end_id.to_bytes(4, "little")
        for batch in it:
            at, start, length, crc, total = [], [], [], [], []
            for i, own in enumerate(texts.many([t or "" for t in batch.column(1).to_pylist()])):
                ids = own.astype("<u4").tobytes() + end
                n = len(ids) // 4
                for low in range(0, n, limit):
                    at.append(i)
                    start.append(low)
                    length.append(min(limit, n - low))
                    crc.append(zlib.crc32(ids[4 * low : 4 * (low + limit)]))
                    total.append(n)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(long(at)), *map(long, (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(give_back(batches), ROW.format(id=kind))


def pack_histogram(histogram: dict[int, int], limit: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pack, number of such packs), from counts of lengths.

    Lengths are placed longest first. A length goes to the packs with the least content, as far as it fits;
    what is left opens packs of its own. Packs with equal content patterns are one entry with a
    count, so the work follows the number of lengths, never that of pieces: each step uses up a length or
    fills all packs of a pattern by one length, and splits at most one pattern.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room left -> patterns
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if not 0 < size <= limit:
            raise ValueError(f"length {size} is not within 1..{limit}")
        while left:
            room = max((r for r in by_room if r >= size), default=None)
            if room is None:
                by_room[limit - size].append(((size,), left))
                break
            pattern, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            take = min(count, left)
            if take < count:
                by_room[room].append((pattern, count - take))
            by_room[room - size].append((pattern + (size,), take))
            left -= take
    return [x for group in by_room.values() for x in group]


def place(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first sequence, offset, repeats): where the ranks of a length go.

    Equal lengths that follow each other in a pattern are one row: `repeats` ranks in turn go to one sequence.
    """
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, count in packs:
        offset = 0
        for size, run in groupby(pattern):
            repeats = len(list(run))
            rows.append((size, used[size], used[size] + count * repeats - 1, sequence, offset, repeats))
            used[size] += count * repeats
            offset += size * repeats
        sequence += count
    return rows


def rank_in_length(pieces: DataFrame, buckets: int = 256) -> DataFrame:
    """Add `rank`, gapless from 0 among the pieces of a length.

    Pieces of a length are numbered in hash buckets of the document, each with a base from a table of counts: a
    length that a third of the rows share is spread over all its buckets.
    """
    from pyspark.sql import Window

    cut = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    cut = cut.withColumn("_r", F.row_number().over(inside))
    cut = cut.join(base, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    return cut.withColumn("rank", F.col("_base") + F.col("_r") - 1).drop("_l", "_b", "_base", "_r", "_bucket")


def pack_pieces(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...).

    Only the histogram, at most `limit` counts, reaches the driver; the placement table, at most a few rows for
    each length and pattern split, is joined back by length and rank.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    rows = place(pack_histogram(histogram, limit))
    # ranks of a length are cut into as many chunks as it has slot rows, so that the join is by equal keys; a slot row comes once for each
    # chunk that it reaches into, which makes the table twice as long at most
    several = Counter(r[0] for r in rows)
    chunk = {size: -(-n // several[size]) for size, n in histogram.items()}
    cut = [(size, part, low, high, at, offset, repeats) for size, low, high, at, offset, repeats in rows for part in range(low // chunk[size], high // chunk[size] + 1)]
    slots = spark.createDataFrame(cut, "_size long, _part long, _low long, _high long, _sequence long, _offset long, _repeats long")
    sizes = spark.createDataFrame(sorted(chunk.items()), "_s long, _chunk long")
    if len(cut) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    ranks = rank_in_length(pieces).join(F.broadcast(sizes), F.col("length") == F.col("_s"))  # at most `limit` rows
    near = ranks.withColumn("_p", F.floor(F.col("rank") / F.col("_chunk"))).join(
        slots, (F.col("length") == F.col("_size")) & (F.col("_p") == F.col("_part")) & (F.col("rank") >= F.col("_low")) & (F.col("rank") <= F.col("_high"))
    )
    place_in = F.col("rank") - F.col("_low")
    near = near.withColumn("sequence_id", F.col("_sequence") + F.floor(place_in / F.col("_repeats"))).withColumn("offset", F.col("_offset") + place_in % F.col("_repeats") * F.col("length"))
    return near.drop("rank", "_s", "_chunk", "_p", "_size", "_part", "_low", "_high", "_sequence", "_offset", "_repeats")


def pack_documents(docs: DataFrame, tokenizer_file: str, limit: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    The pieces are written once to the shared folder, as the histogram and the join both read them. An
    empty table gives no pieces; null ids are kept; columns besides doc_id and text are ignored.
    """
    return pack_pieces(materialise(token_pieces(docs, tokenizer_file, end_id, limit)), limit)
