"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.llm.common import pieces

SLOTS = 64
#: Phrase names of these levels make the fingerprint: about 3^level bytes a phrase.
LEVELS = (2, 3)
_RNG = np.random.Generator(np.random.Philox(6))
_CODE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_SALT = _RNG.integers(0, 1 << 64, SLOTS, dtype=np.uint64)
_FACTOR = _RNG.integers(0, 1 << 64, SLOTS, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _toss(label: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: the lowest bit that differs from the left neighbour, and its value."""
    differ = label ^ left
    lowest = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(lowest - np.uint64(1)).astype(np.uint64)
    return (place << np.uint64(1)) | ((label >> place) & np.uint64(1))


def _names(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One name for each run of values, of the values in order."""
    step = np.arange(len(values)) - np.repeat(begin, size)
    weight = _mix(step.astype(np.uint64) + _ODD) | np.uint64(1)
    return _mix(np.add.reduceat(_mix(values) * weight, begin) + size.astype(np.uint64))


def parse_level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names, and which of them begin a text; `first` marks the symbols that begin one.

    Runs of one symbol become one symbol. Then coin tossing shortens each symbol to a label of under 6 by a
    few left neighbours, and phrases begin at the labels' local minima, so whether a phrase begins at a place
    depends on a few symbols around it and not on its distance from the text's begin.
    """
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(names)]]))
    x = np.where(size > 1, _mix(names[begin] + size.astype(np.uint64) * _ODD), names[begin])
    head = first[begin]
    label = x
    for _ in range(4):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[head] = label[head] ^ np.uint64(1)
        label = _toss(label, left)
    least = np.ones(len(x), bool)
    least[1:] &= label[1:] < label[:-1]
    least[:-1] &= (label[:-1] <= label[1:]) | head[1:]
    least[1:] &= ~head[:-1]  # a phrase of one symbol at a text's begin tells little
    least |= head
    begin = np.flatnonzero(least)
    return _names(x, begin, np.diff(np.concatenate([begin, [len(x)]]))), head[begin]


def sketches(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit minima over each text's phrase names; all 0 for empty texts."""
    n = len(offsets) - 1
    out = np.zeros((n, SLOTS), np.uint16)
    held = np.flatnonzero(np.diff(offsets) > 0)
    if not len(held):
        return out
    names, first = _CODE[raw], np.zeros(len(raw), bool)
    first[offsets[held]] = True
    kept, begins, level = [], [], 0
    while level < max(LEVELS):
        names, first = parse_level(names, first)
        level += 1
        if level in LEVELS:
            kept.append(names)
            begins.append(np.flatnonzero(first))
    least = np.full((SLOTS, len(held)), np.iinfo(np.uint64).max, np.uint64)
    for values, begin in zip(kept, begins, strict=True):
        for k in range(SLOTS):
            np.minimum(least[k], np.minimum.reduceat((values ^ _SALT[k]) * _FACTOR[k], begin), out=least[k])
    out[held] = (_mix(least) >> np.uint64(48)).astype(np.uint16).T
    return out


def _sketch_texts(texts: list[bytes]) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    parts = [sketches(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, 1 << 19)]
    return np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots of fingerprints, an estimate of the Jaccard index of their phrase names."""
    return (a == b).mean(axis=-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a map, nothing is shuffled. Null text: that of the empty text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = _sketch_texts([(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in got], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, fingerprint string")


def _ranges(docs: DataFrame, rows: int) -> list[int]:
    """Splits of the ids into ranges of about `rows` rows; as many numbers as ranges reach the driver."""
    n = docs.count()
    parts = min(50_000, max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // rows)))
    shares = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else None
    return sorted(set(got or []))


def with_next(docs: DataFrame, rows: int = 5_000) -> DataFrame:
    """(_b, _ghost, doc_id, text), dealt out so that the rows of a range of ids follow each other, ids descending.

    Each range ends with a ghost: the first row of the next lower range that has rows, or of the highest after the
    lowest. So each row's next one stands in its own partition, and a text is shuffled once. Equal ids are in the
    order of their texts; null ids come last.
    """
    splits = np.array(_ranges(docs, rows), np.int64)

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        held = ids.notna().to_numpy()  # nulls are a range of their own, the lowest
        return pd.Series(np.searchsorted(splits, ids.fillna(0).to_numpy(np.int64), side="right").astype(np.int32) + 1) * held

    text = F.coalesce("text", F.lit(""))
    rows_of = docs.select(of(F.col("doc_id").cast("long")).alias("_b"), "doc_id", text.alias("text"))
    heads = docs.select(of(F.col("doc_id").cast("long")).alias("_b"), "doc_id").groupBy("_b").agg(F.max("doc_id").alias("head"))
    below = Window.orderBy("_b")  # a row for each range, not for each document
    heads = heads.select(F.coalesce(F.lead("_b").over(below), F.first("_b").over(below)).alias("_up"), "head")
    ghosts = docs.select("doc_id", text.alias("text")).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    both = rows_of.select("_b", F.lit(False).alias("_ghost"), "doc_id", "text").union(ghosts.select(F.col("_up"), F.lit(True), "doc_id", "text"))
    return both.repartition("_b").sortWithinPartitions("_b", "_ghost", F.desc_nulls_last("doc_id"), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last third is the next text's begin.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A single
    document is its own next one. Repeated rows are returned as often as they are there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # the last row, whose next one isn't known yet

        def made(rows: list[tuple], nexts: list[tuple], schema) -> pa.RecordBatch:
            own = _sketch_texts([t.encode("utf-8", "replace") for *_, t in rows])
            edited = [(t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode("utf-8", "replace") for (*_, t), (*_, u) in zip(rows, nexts, strict=True)]
            cut = _sketch_texts(edited)
            following = np.concatenate([own[1:], _sketch_texts([nexts[-1][3].encode("utf-8", "replace")])])
            seam = [i for i in range(len(rows) - 1) if rows[i + 1] is not nexts[i]]
            if seam:
                following[seam] = _sketch_texts([nexts[i][3].encode("utf-8", "replace") for i in seam])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows], schema), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                 pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in cut]), pa.array(likeness(own, cut)), pa.array(likeness(own, following))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in it:
            flow = waiting + list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            rows, nexts = [], []
            for a, b in zip(flow, flow[1:], strict=False):
                if not a[1]:
                    rows.append(a)
                    nexts.append(b)
            waiting = flow[-1:]
            if rows:
                yield made(rows, nexts, batch.schema.field(2).type)
        if waiting and not waiting[0][1]:
            raise ValueError("a range of ids has no ghost")

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(batches, schema)
