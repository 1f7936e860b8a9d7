"""Removal of byte strings that occur more than once, decided on suffix arrays."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispersa.llm.common import drop_table, give_back, materialise, pieces, text_buffer

SPAN = 200
GRAM = 64
#: Different segments that a task holds together for one suffix array; larger groups are cut by BLOCK windows, then by single ones.
GROUP = 1024
BLOCK = 16
_BITS = 21  # of a place within a piece; a piece has at most 2**_BITS bytes
_ODD = 0x9E3779B97F4A7C15 | 1


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of all suffixes, by grouping on Lyndon prefixes.

    First, suffixes are grouped by their Lyndon prefix: starting from groups by symbol, groups are taken
    in descending order; each member points to its previous smaller group's suffix, and the suffixes
    pointed to move to new groups right behind their old ones, more hits further behind. Then the groups' places
    are filled in ascending order: whatever a suffix just placed completes, along the pointers, comes next in
    its group. No ranks are recomputed.
    """
    n = len(text)
    symbols = np.asarray(text)
    sa = np.argsort(symbols, kind="stable").tolist()
    at = [0] * n  # place of a suffix in sa
    link = [0] * n  # first place of its group
    size = [0] * (n + 1)  # of the group that begins at a place
    begin, last = 0, None
    for place, s in enumerate(sa):
        if text[s] != last:
            begin, last = place, text[s]
        at[s] = place
        link[s] = begin
        size[begin] += 1
    previous = [-1] * n
    high = n - 1
    while high >= 0:
        low = link[sa[high]]
        if low == high:
            s = sa[low]
            p = s - 1
            while p >= 0 and link[p] >= low:
                p = previous[p]
            previous[s] = p
            by_hits = [(p,)] if p >= 0 else ()
        else:
            hits = []
            for s in sorted(sa[low : high + 1]):
                p = s - 1
                while p >= 0 and link[p] >= low:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    hits.append(p)
            counted = Counter(hits)
            if len(counted) == len(hits):
                by_hits = [hits] if hits else ()
            else:
                levels: dict[int, list[int]] = {}
                for p, k in counted.items():
                    levels.setdefault(k, []).append(p)
                by_hits = [levels[k] for k in sorted(levels, reverse=True)]
        for moved in by_hits:
            for p in moved:
                g = link[p]
                size[g] -= 1
                end = g + size[g]
                here, other = at[p], sa[end]
                sa[here], at[other] = other, here
                sa[end], at[p] = p, end
            for p, fresh in zip(moved, [link[p] + size[link[p]] for p in moved], strict=True):
                link[p] = fresh
                size[fresh] += 1
        high = low - 1
    out, done, free = [0] * n, [False] * n, list(range(n))  # free: next place to fill of the group that begins there
    place, s = -1, n
    while True:
        p = s - 1
        while p >= 0 and not done[p]:
            g = link[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = previous[p]
        place += 1
        if place >= n:
            return out
        s = out[place]


class _Rolling:
    """Polynomial hashes of all substrings of a piece, in wrapping 64-bit arithmetic over random byte codes."""

    def __init__(self, size: int = 1 << _BITS):
        rng = np.random.Generator(np.random.Philox(20))
        self.code = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.size = 0
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        size = 1 << (size - 1).bit_length()
        inverse = pow(_ODD, -1, 1 << 64)
        powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        for k, odd in enumerate((_ODD, inverse)):
            while len(powers[k]) < size:
                step = np.uint64(pow(odd, len(powers[k]), 1 << 64))
                powers[k] = np.concatenate([powers[k], powers[k] * step])
        self.up, self.down, self.size = *powers, size

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) + 1 > self.size:
            self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, low: np.ndarray | slice, high: np.ndarray | slice, salt: np.ndarray | int = 0) -> np.ndarray:
        h = (sums[high] - sums[low]) * self.down[low] + np.asarray(salt, np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def anchored_segments(raw: np.ndarray, offsets: np.ndarray, span: int, gram: int, rolling: _Rolling):
    """Arrays (row, first window, windows, anchor, gram hash, segment hash): runs of windows with one anchor.

    A window is `span` bytes of one text. Its anchor is the gram with the least hash within it, the first of
    equals, so equal windows have equal anchors at the same place. Windows next to each other that share
    their anchor form a segment, which reaches from the first one's begin to the last one's end. `raw` may be a
    part of one long text.
    """
    n = len(raw)
    if n < span:
        return None
    sums = rolling.sums(raw)
    grams = rolling.of(sums, slice(0, n - gram + 1), slice(gram, n + 1))
    least = (grams >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width, reach = span - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    ends = offsets[1:]
    row = np.repeat(np.arange(len(ends)), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + span <= ends[row]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return None
    edge = np.flatnonzero(new | ~inside)
    after = np.searchsorted(edge, first, side="right")
    last = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], len(anchor))
    segment = rolling.of(sums, first, last - 1 + span, last - first)
    return row[first], first - offsets[row[first]], last - first, anchor[first] - first, grams[anchor[first]], segment


def _parts(raw: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets): pieces of rows, long rows in overlapping parts."""
    most = 1 << (_BITS - 1)
    for low, high in pieces(offsets):
        size = offsets[high] - offsets[low]
        if size <= most:
            yield low, 0, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        else:
            for at in range(0, size - span + 1, most - span):
                part = raw[offsets[low] + at : offsets[low] + min(size, at + most - 1)]
                yield low, at, part, np.array([0, len(part)])


ANCHORS = "doc_id {id}, th long, start int, n int, off int, h long, seg long"
_KEY = ["doc_id", "th"]


def _anchors(rows: DataFrame, span: int, gram: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        for batch in it:
            raw, offsets = text_buffer(batch.column(2))
            for low, at, part, cuts in _parts(raw, offsets, span):
                found = anchored_segments(part, cuts, span, gram, rolling)
                if found is None:
                    continue
                row, start, n, off, h, seg = found
                take = pa.array(row + low)
                whole = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), whole(start + at), whole(n), whole(off), pa.array(h.view(np.int64)), pa.array(seg.view(np.int64))],
                    ["doc_id", "th", "start", "n", "off", "h", "seg"],
                )

    return rows.select("doc_id", "th", "text").mapInArrow(give_back(batches), ANCHORS.format(id=kind))


def _same_key(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right._d) & (left.th == right._t)


def _segment_bytes(rows: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The wanted segments with their bytes: one row a document is joined with its text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("h", "copies", "crowded", "start", "n", "off")).alias("s"))
    joined = rows.join(lists, _same_key(rows, lists)).select("doc_id", "th", "text", "s")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = text_buffer(batch.column(2))
            lists = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            s = lists.flatten()
            start, n = (np.asarray(s.field(k)).astype(np.int64) for k in (3, 4))
            low = offsets[of] + start
            data = raw.tobytes()
            body = [data[a : a + k] for a, k in zip(low.tolist(), (n - 1 + span).tolist(), strict=True)]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *[s.field(k) for k in range(6)], pa.array(body, pa.binary())],
                ["doc_id", "th", "h", "copies", "crowded", "start", "n", "off", "body"],
            )

    return joined.mapInArrow(give_back(batches), f"doc_id {kind}, th long, h long, copies long, crowded boolean, start int, n int, off int, body binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeated_windows(members: Sequence[tuple[bytes, int, int]], span: int) -> list[np.ndarray]:
    """For each member (bytes, windows, place of the anchor) of a group, which of its windows another member holds.

    The members are joined to one string, in which what all have in common around the anchor is a single
    symbol; equal windows all hold that symbol, at one place in it, so their suffixes stand together in the
    string's suffix array. Each suffix is held against its neighbours there, byte for byte.
    """
    first, _, at = members[0]
    left = min(_common(first[:at][::-1], b[:p][::-1]) for b, _, p in members)
    right = min(_common(first[at:], b[p:]) for b, _, p in members)
    text: list[int] = []
    base, flank = [], []
    for b, _, p in members:
        base.append(len(text))
        flank.append(p - left)
        text += [x + 1 for x in b[: p - left]]
        text.append(257)
        text += [x + 1 for x in b[p + right :]]
        text.append(0)
    order = suffix_array(text)
    owner = np.searchsorted(np.array(base), np.array(order), side="right") - 1
    flags = [np.zeros(n, bool) for _, n, _ in members]
    inner: list[int] = []
    outer: list[tuple[int, int, int]] = []
    for m, pos in zip(owner.tolist(), order, strict=True):
        start = pos - base[m]
        if start == flank[m]:
            inner.append(m)
        if start < flank[m] and start < members[m][1]:
            outer.append((m, start, len(outer)))
    for (m, s, _), (k, t, _) in zip(outer, outer[1:], strict=False):
        if (m != k or s != t) and members[m][0][s : s + span] == members[k][0][t : t + span]:
            flags[m][s] = flags[k][t] = True
    # windows that begin within the common part: the right flank decides how far they may reach
    best = [-1] * len(members)
    for m, k in zip(inner, inner[1:], strict=False):
        a, b = members[m], members[k]
        same = _common(a[0][a[2] + right :], b[0][b[2] + right :])
        best[m], best[k] = max(best[m], same), max(best[k], same)
    for m, (_, n, p) in enumerate(members):
        if best[m] >= 0:
            flags[m][max(0, p - left) : max(0, min(n, p + right + best[m] - span + 1))] = True
    return flags


SPANS = "doc_id {id}, th long, start int, bytes int"


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs that are set."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _group_spans(segments: DataFrame, span: int) -> DataFrame:
    """Repeated spans of the segments with one copy, by a suffix array for each gram hash; groups are bounded by GROUP."""
    kind = segments.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def solve(out: list[tuple]) -> None:
            if len(group) > 1 and any(g[3] == 1 for g in group):
                flags = repeated_windows([(g[8], g[6], g[7]) for g in group], span)
                for g, flag in zip(group, flags, strict=True):
                    if g[3] == 1:
                        for a, b in zip(*_runs(flag), strict=True):
                            out.append((g[0], g[1], g[5] + int(a), int(b - a) - 1 + span))
            group.clear()

        def made(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "th", "start", "bytes"])

        types = None
        for batch in it:
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()]
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[-1][2] != row[2]:
                    solve(out)
                group.append(row)
            yield made(out)
        if types is not None:
            out = []
            solve(out)
            yield made(out)

    return segments.repartition("h").sortWithinPartitions("h", "doc_id", "th", "start").mapInArrow(give_back(batches), SPANS.format(id=kind))


PART = "doc_id {id}, th long, h long, copies long, r long, start int, n int, off int, body binary"


def _cut_segments(segments: DataFrame, span: int, width: int) -> DataFrame:
    """The segments cut into parts of up to `width` windows, grouped more finely than by their gram.

    Parts lie at fixed distances from the anchor. All windows of a part have most of their bytes in common, their core;
    windows of parts with different cores differ, so the core's hash is the part's group. With one window a part,
    the core is the window itself. `r` is the hash of all bytes of the part.
    """
    kind = segments.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        for batch in it:
            body = batch.column("body").to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int64)
            data = b"".join(body)
            sums = rolling.sums(np.frombuffer(data, np.uint8))
            n, off, start = (np.asarray(batch.column(k)).astype(np.int64) for k in ("n", "off", "start"))
            # windows 0..n - 1 of a segment are off, off - 1, ... bytes before the anchor
            near, far = (off - n + 1) // width, off // width
            count = far - near + 1
            of = np.repeat(np.arange(len(n)), count)
            part = np.repeat(far, count) - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
            first = np.maximum(off[of] - ((part + 1) * width - 1), 0)
            last = np.minimum(off[of] - part * width, n[of] - 1)
            at = offsets[of] + off[of]  # place of the anchor
            core = rolling.of(sums, at - part * width, at - (part + 1) * width + 1 + span, part)
            low, high = offsets[of] + first, offsets[of] + last + span
            whole = rolling.of(sums, low, high, high - low)
            h = core ^ (np.asarray(batch.column("h")).view(np.uint64)[of] * np.uint64(_ODD))
            take = pa.array(of)
            int32 = lambda x: pa.array(x.astype(np.int32))
            bodies = pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)] if width > 1 else [b""] * len(of), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(h.view(np.int64)), batch.column("copies").take(take), pa.array(whole.view(np.int64)),
                 int32(start[of] + first), int32(last - first + 1), int32(off[of] - first), bodies],
                ["doc_id", "th", "h", "copies", "r", "start", "n", "off", "body"],
            )

    return segments.mapInArrow(batches, PART.format(id=kind))


def _crowded_spans(segments: DataFrame, span: int) -> DataFrame:
    """Repeated spans of segments whose gram has too many different ones for a task.

    Cut into parts of BLOCK windows, most meet few others, and a suffix array decides as before; what is still
    crowded is cut into single windows and counted.
    """
    parts = materialise(_cut_segments(segments, span, max(1, min(BLOCK, span // 4))))  # a core needs bytes
    known = parts.groupBy("h", "r").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n", "off", "body")).alias("one"))
    known = materialise(known)
    spans = _whole(parts, known, span)
    kinds = known.groupBy("h").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 AND fewest = 1")
    rest = materialise(known.join(kinds, "h").select("one.doc_id", "one.th", "h", "copies", (F.col("kinds") > GROUP).alias("crowded"), "one.start", "one.n", "one.off", "one.body"))
    spans = spans.union(_group_spans(rest.where("NOT crowded"), span))
    still = rest.where("crowded")
    if still.isEmpty():
        return spans
    windows = materialise(_cut_segments(still, span, 1).drop("body"))
    return spans.union(_whole(windows, windows.groupBy("h", "r").agg(F.sum("copies").alias("copies")), span))


def _whole(parts: DataFrame, known: DataFrame, span: int) -> DataFrame:
    """Spans of the parts with one copy whose bytes another part has."""
    twice = known.where("copies > 1").select("h", "r")
    return parts.where("copies = 1").join(twice, ["h", "r"], "left_semi").select("doc_id", "th", "start", (F.col("n") - 1 + span).alias("bytes"))


def keyed_documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, th, text, ...): a hash of the text tells rows with one id apart. Carried columns come as one struct."""
    text = F.coalesce("text", F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"), *more)


def repeated_spans(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, start, bytes): spans that cover all repeated strings of `span` bytes of keyed documents, overlapping.

    1. Every window of `span` bytes belongs to the segment of its anchor (see anchored_segments), about one row
       for 70 bytes. Grams that occur once can't be in a repeated string.
    2. Segments that occur twice are repeated as a whole.
    3. Where a gram has several different segments, one of each comes together with the others, with its
       bytes: up to GROUP of them in a task, where a suffix array decides; more are cut first (_crowded_spans).
    """
    anchors = materialise(_anchors(rows, span, gram))
    # a table of its own, so that a gram that very many documents share can be split in the join
    twice = materialise(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    shared = materialise(anchors.join(twice, "h", "left_semi"))
    drop_table(anchors)
    known = materialise(shared.groupBy("h", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n", "off")).alias("one")))
    whole = shared.join(known.where("copies > 1").select("h", "seg"), ["h", "seg"], "left_semi")
    whole = whole.select("doc_id", "th", "start", (F.col("n") - 1 + span).alias("bytes"))
    mixed = known.groupBy("h").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 AND fewest = 1")
    wanted = known.join(mixed, "h").select("h", "copies", (F.col("kinds") > GROUP).alias("crowded"), "one.*")
    segments = materialise(_segment_bytes(rows, wanted, span))
    spans = whole.union(_group_spans(segments.where("NOT crowded"), span))
    crowded = segments.where("crowded")
    return spans if crowded.isEmpty() else spans.union(_crowded_spans(crowded, span))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, kept: str = "bytes", carry: Sequence[str] = ()) -> DataFrame:
    """Each document without the bytes that repeated strings of `span` bytes cover.

    Returns doc_id, n_bytes, n_removed, n_spans, removed (the maximal runs, as structs of start and length) and
    what is kept: its "bytes", their "sha256" in hex, or the "text" without characters that a removal has cut; then
    a struct `carried` of other columns, where some are named. Null and empty texts have nothing to remove; equal rows lose all they share; strings
    never cross documents. Ids may be null.
    """
    rows = keyed_documents(docs, carry)
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = repeated_spans(rows.select("doc_id", "th", "text"), span, gram).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    lists = lists.agg(F.collect_set(F.struct("start", "bytes")).alias("s"))
    more = ["carried"] if carry else []
    joined = rows.join(lists, _same_key(rows, lists), "left").select("doc_id", "text", "s", *more)
    as_kept = {"bytes": bytes, "sha256": lambda k: hashlib.sha256(k).hexdigest(), "text": lambda k: k.decode("utf-8", "ignore")}[kept]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept", *more]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [_without(text.as_buffer().to_pybytes(), spans) for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            long = lambda x: pa.array(x, pa.int64())
            runs = pa.array([[{"start": a, "length": b - a} for a, b in r] for r, _, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            left = pa.array([as_kept(k) for *_, k in found], pa.binary() if kept == "bytes" else pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), long([n for _, n, _ in found]), long([n - len(k) for _, n, k in found]), long([len(r) for r, _, _ in found]), runs, left, *batch.columns[3:]], names
            )

    schema = StructType.fromDDL(f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:int,length:int>>, kept {'binary' if kept == 'bytes' else 'string'}")
    if carry:
        schema.add("carried", rows.schema["carried"].dataType)
    return joined.mapInArrow(batches, schema)


def _without(raw: bytes, spans: Sequence[dict] | None) -> tuple[list[tuple[int, int]], int, bytes]:
    """Maximal runs that the spans cover, the size of the text, and the rest of it."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted((s["start"], s["start"] + s["bytes"]) for s in spans or ()):
        if runs and low <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], high)
        else:
            runs.append((low, high))
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return runs, len(raw), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
