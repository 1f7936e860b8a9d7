"""Embedding near-dedup: an inverted multi-index over vector halves, visited to a target recall, links verified exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import components, give_back, materialise

#: Vectors that the codebooks and the radius of a visit are fitted on: those of the least hashes, at any number of vectors.
SAMPLE = 16384

#: Vectors of a cell on average, and centroids of a half at most.
CELL, MOST_CENTROIDS = 200, 1024

#: Members and visitors of a cell that one task compares; a fuller cell is several tasks.
BLOCK = 2048


def _raw(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Bytes of the usable vectors, with a digest of them; null for the others."""
    for batch in batches:
        vectors = batch.column("vector")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
        flat[flat == 0] = 0  # no negative zero
        ends = np.cumsum(pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False))
        raw: list[bytes | None] = []
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = flat[low:high]
            raw.append(own.tobytes() if high > low and np.isfinite(own).all() and own.any() else None)
        same = [None if x is None else hashlib.md5(x).digest() for x in raw]
        length = [0 if x is None else len(x) // flat.itemsize for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), pa.array(same, pa.binary()), pa.array(length, pa.int32())], names=["id", "raw", "same", "length"])


def unit(raw: list[bytes] | pa.Array, kind: type) -> np.ndarray:
    """Rows of length 1, in doubles."""
    raw = raw.to_pylist() if isinstance(raw, (pa.Array, pa.ChunkedArray)) else raw
    rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * rows @ book.T, 0)


def _centroids(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = rows[np.sort(rng.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    for _ in range(rounds):
        nearest = _distances(rows, book).argmin(1)
        n = np.bincount(nearest, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, rows)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


class MultiIndex:
    """A codebook a half, whose product is the grid of cells, and the radius within which cells are visited.

    A cell's distance from a vector is the sum of the halves' squared distances from its centroids. Beyond its nearest cell a vector
    visits all cells that are farther by `radius` at most. The radius is the one at which a vector turned by the angle of the
    least similarity, in a random direction, lies in a visited cell with chance `target`.
    """

    def __init__(self, sample: np.ndarray, k: int, least: float, target: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [_centroids(half, k, rng) for half in self._halves(sample)]
        turned = rng.normal(size=sample.shape)
        turned -= (turned * sample).sum(1, keepdims=True) * sample
        turned /= np.maximum(np.sqrt((turned * turned).sum(1, keepdims=True)), 1e-300)
        turned = least * sample + np.sqrt(max(0.0, 1 - least * least)) * turned
        far = np.zeros(len(sample))
        for own, other, book in zip(self._halves(sample), self._halves(turned), self.books):
            at = _distances(own, book)
            far += at[np.arange(len(at)), _distances(other, book).argmin(1)] - at.min(1)
        self.radius = float(np.quantile(far, target))

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.half], rows[:, self.half :]

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) pairs in the order of a multi-sequence walk: each half's centroids by distance, and for each of the
        first's the second's while the sum stays within the radius. A vector's first pair is its own cell."""
        first, second = (_distances(half, book) for half, book in zip(self._halves(rows), self.books))
        by = [np.argsort(d, axis=1, kind="stable") for d in (first, second)]
        gaps = [np.take_along_axis(d, o, 1) for d, o in zip((first, second), by)]
        gaps = [g - g[:, :1] for g in gaps]
        who, cells, width = [], [], len(self.books[1])
        for a in range(gaps[0].shape[1]):
            near = np.flatnonzero(gaps[0][:, a] <= self.radius)
            if not len(near):
                break
            inside = gaps[1][near] <= (self.radius - gaps[0][near, a])[:, None]
            r, b = np.nonzero(inside)
            who.append(near[r])
            cells.append(by[0][near[r], a] * width + by[1][near[r], b])
        who, cells = np.concatenate(who), np.concatenate(cells)
        order = np.argsort(who, kind="stable")
        return who[order], cells[order]


def _walk(batches: Iterator[pa.RecordBatch], index: MultiIndex, kind: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            who, cells = index.visits(unit(batch.column("raw"), kind))
            at = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "copies", "raw")), pa.array(cells[at[:-1]].astype(np.int32)), lists], names=["row", "copies", "raw", "home", "visits"])


def _labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least visitor number reachable from each visitor and each member of a block."""
    n = len(linked)
    of_visitor, none = np.arange(n), n
    while True:
        of_member = np.where(linked, of_visitor[:, None], none).min(0)
        better = np.minimum(of_visitor, np.where(linked, of_member[None], none).min(1))
        if (better == of_visitor).all():
            return of_visitor, of_member
        of_visitor = better


def _verify(kind: type, least: float) -> Callable[[pa.Table], pa.Table]:
    """(row, links, root) of a block: what each vector links to for the first time here, and one row for its links to hang on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        member = table.column("member").to_numpy()
        row, copies = table.column("row").to_numpy(), table.column("copies").to_numpy()
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        if not len(m) or not len(q):
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "links", "root")})
        rows = unit(table.column("raw"), kind)
        linked = rows[q] @ rows[m].T >= least
        linked &= row[q][:, None] != row[m][None]
        to_visitor = linked @ copies[m].astype(np.float64)
        home, cell = table.column("home").to_numpy(), table.column("cell").to_numpy()[0]
        lists = table.column("visits").combine_chunks()
        visited, visitor = lists.flatten().to_numpy(), np.repeat(np.arange(len(row)), np.diff(lists.offsets.to_numpy()))
        to_member = np.zeros(len(m))
        for other in np.unique(home[q][home[q] != cell]):  # a member that visits the visitor's cell as well finds the link there
            back = np.zeros(len(row), bool)
            back[visitor[visited == other]] = True
            theirs = home[q] == other
            to_member += np.where(back[m], 0.0, copies[q[theirs]].astype(np.float64) @ linked[theirs])
        roots, below = _labels(linked)
        has, met = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        out = np.concatenate([row[q[has]], row[m[met]]]), np.concatenate([to_visitor[has], to_member[met]]).astype(np.int64), np.concatenate([row[q[roots[has]]], row[q[below[met]]]])
        return pa.table({c: pa.array(x) for c, x in zip(("row", "links", "root"), out)})

    return run


def _links(reps: DataFrame, n: int, kind: type, least: float, target: float, block: int, cell: int) -> DataFrame:
    """(row, links, root) of all vectors of one length."""
    sample = [r.raw for r in reps.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()]
    index = MultiIndex(unit(sample, kind), int(min(MOST_CENTROIDS, max(1, np.ceil(np.sqrt(n / cell))))), least, target)
    found = materialise(reps.select("row", "copies", "raw").mapInArrow(give_back(lambda it: _walk(it, index, kind)), "row long, copies long, raw binary, home int, visits array<int>"))
    columns = ["row", "copies", "raw", "home", "visits"]
    member = found.select(F.col("home").alias("cell"), F.lit(True).alias("member"), *columns)
    visitor = found.select(F.explode("visits").alias("cell"), F.lit(False).alias("member"), *columns)
    sizes = visitor.groupBy("cell").agg(F.count("*").alias("_q"), F.count_if(F.col("cell") == F.col("home")).alias("_m")).where("_m > 0")
    sizes = sizes.select("cell", F.ceil(F.col("_q") / block).alias("_as"), F.ceil(F.col("_m") / block).alias("_bs"))
    own = lambda n: F.array(F.pmod(F.xxhash64("row"), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    both = member.union(visitor).join(sizes, "cell")
    dealt = both.withColumn("a", F.explode(F.when(F.col("member"), every("_as")).otherwise(own("_as")))).withColumn("b", F.explode(F.when(F.col("member"), own("_bs")).otherwise(every("_bs"))))
    return dealt.drop("_as", "_bs").groupBy("cell", "a", "b").applyInArrow(_verify(kind, least), "row long, links long, root long")


def linked_vectors(vectors: DataFrame, vec_key: str = "vec_id", vector: str = "embedding", least: float = 0.95, target: float = 0.99, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(vec_key, n_links, component_id, kept) of each row: links of cosine `least` or more, the least id reachable by them.

    Equal vectors are one row of the index with a number of copies. The codebooks and the radius come from a sample of SAMPLE
    vectors; every vector is indexed and every vector is a query. A pair is found if either vector visits the other's cell, and is
    then tested in doubles, so `target` bounds the recall from below and precision is 1. A task compares a block of a cell's members with a
    block of its visitors and returns sums and one root a vector, never pairs.

    Null, empty and zero vectors and those with null or non-finite parts link with nothing and stand alone; vectors of different
    lengths don't link. Rows of equal ids are vectors of their own; a null id is never a component's id unless all of it have none,
    and `kept` is false for it. Other columns are ignored.
    """
    kind = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64
    id_kind = dict(vectors.dtypes)[vec_key]
    asked = vectors.select(F.col(f"`{vec_key}`").alias("id"), F.col(f"`{vector}`").cast("array<float>" if kind == np.float32 else "array<double>").alias("vector"))
    rows = asked.mapInArrow(give_back(lambda it: _raw(it, kind)), f"id {id_kind}, raw binary, same binary, length int")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    classes = materialise(rows.where("same IS NOT NULL").groupBy("same", "length").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("id").alias("least_id")))
    reps = materialise(rows.join(classes.select("row", "copies"), "row").select("row", "copies", "raw", "length"))
    found = None
    for length, n in reps.groupBy("length").count().orderBy("length").collect():
        more = _links(reps.where(F.col("length") == length), n, kind, least, target, block, cell)
        found = more if found is None else found.union(more)
    if found is None:
        return rows.select(F.col("id").alias(vec_key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = materialise(found)
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    named = components(found, "row", "root").withColumnRenamed("node", "row")
    known = classes.join(links, "row", "left").join(named, "row", "left").withColumn("component", F.coalesce("component", "row"))
    known = materialise(known.select("same", "length", "copies", "least_id", "links", "component"))
    least_id = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_id, "component").select("same", "length", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "same", "length").join(known, ["same", "length"], "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec_key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
