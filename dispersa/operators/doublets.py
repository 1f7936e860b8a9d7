"""Doublet scores: units among simulated sums of two units, by nearest neighbours in a space of leading components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispersa.sources.results import checkpointed

#: Points that a task compares: rows of a block of queries and of a block of points; blocks of queries whose nearest points a task holds.
QUERIES, POINTS, HELD = 4096, 16_384, 2
#: Rows of queries and of points whose products stay in a core's cache.
ROWS, COLUMNS = 256, 1024
#: Places of squared distances: copies of a unit may differ by rounding.
DIGITS = 9


def numbered(units: DataFrame) -> DataFrame:
    """(unit, pos, n): units numbered from 0 by buckets of a hash, so that no task numbers them all."""
    cut = units.select("unit").withColumn("_b", F.pmod(F.xxhash64("unit"), F.lit(4096)))
    counted = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before, every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = counted.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(every).alias("n"))
    return cut.join(base, "_b").select("unit", (F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("unit")) - 1).alias("pos"), "n")


def simulated(counts: DataFrame, units: DataFrame, n_sim: int, seed: int, pick=None) -> DataFrame:
    """(id, feature, y): sums of two different units each, picked by hashes of the simulated unit's number."""
    n = F.lit(units.count())
    hashed = pick or (lambda i, side: F.xxhash64(F.lit(seed), i, F.lit(side)))
    ids = counts.sparkSession.range(n_sim).withColumn("a", F.pmod(hashed(F.col("id"), 0), n)).withColumn("b", F.pmod(hashed(F.col("id"), 1), n))
    ids = ids.withColumn("b", F.when(F.col("a") == F.col("b"), (F.col("b") + 1) % n).otherwise(F.col("b")))
    both = ids.select("id", F.explode(F.array("a", "b")).alias("pos")).join(units.select("unit", "pos"), "pos")
    # dealt by simulated unit, so that its library and its list of features need no further shuffle
    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.sparkSession.sparkContext.defaultParallelism)
    return both.join(counts, "unit").repartition(tasks, "id").groupBy("id", "feature").agg(F.sum("y").alias("y"))


def log_scaled(counts: DataFrame, key: str, depth: float) -> DataFrame:
    """(key, feature, x): log(1 + y / library * depth); what isn't stored is 0."""
    lib = F.sum("y").over(Window.partitionBy(key))
    return counts.withColumn("_l", lib).where("y > 0").select(key, "feature", F.log1p(F.col("y") / F.col("_l") * depth).alias("x"))


def most_variable(scaled: DataFrame, n: int, many: int) -> DataFrame:
    """(feature, at, mean): the `many` features of the largest variance over n units, in order."""
    s = scaled.groupBy("feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    first = s.orderBy(F.desc(F.round(F.col("q") - F.col("s") * F.col("s") / n, 9)), "feature").limit(many)
    return first.withColumn("at", F.row_number().over(Window.orderBy("feature")) - 1).select("feature", "at", (F.col("s") / n).alias("mean"))


def _dense(pdf: pd.DataFrame, p: int) -> np.ndarray:
    x = np.zeros((len(pdf), p))
    for row, (at, v) in enumerate(zip(pdf["at"], pdf["v"])):
        x[row, at] = v
    return x


def embedded(scaled: DataFrame, keys: DataFrame, key: str, features: DataFrame, turn: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, e): each unit of `keys` on the components `turn` (means, rotation)."""
    lists = scaled.join(F.broadcast(features), "feature").groupBy(key).agg(F.collect_list("at").alias("at"), F.collect_list("x").alias("v"))
    none = lambda t: F.array().cast(f"array<{t}>")
    whole = keys.select(key).join(lists, key, "left").select(key, F.coalesce("at", none("int")).alias("at"), F.coalesce("v", none("double")).alias("v"))
    mean, rotation = turn

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "e": list((_dense(pdf, len(mean)) - mean) @ rotation)})

    return whole.mapInPandas(run, f"{key} {dict(keys.dtypes)[key]}, e array<double>")


def components(scaled: DataFrame, n: int, features: DataFrame, n_pc: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, rotation) of the chosen features' principal components over n units; the products of features, whose number is a
    parameter, are summed by tasks and decomposed by the driver."""
    mean = np.array([r.mean for r in features.orderBy("at").collect()])
    p = len(mean)
    lists = scaled.join(F.broadcast(features), "feature").groupBy("unit").agg(F.collect_list("at").alias("at"), F.collect_list("x").alias("v"))

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((p, p))
        for pdf in it:
            if len(pdf):
                x = _dense(pdf, p)
                gram += x.T @ x
        yield pd.DataFrame({"row": np.arange(p), "v": list(gram)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    rows = lists.mapInPandas(partial, "row int, v array<double>").groupBy("row").applyInPandas(add, "row int, v array<double>").collect()
    gram = np.zeros((p, p))
    for r in rows:
        gram[r.row] = r.v
    values, vectors = np.linalg.eigh((gram - n * np.outer(mean, mean)) / (n - 1))
    first = np.argsort(-values, kind="stable")[: min(n_pc, p)]
    rotation = vectors[:, first]
    return mean, rotation * np.sign(rotation[np.abs(rotation).argmax(0), np.arange(len(first))])


def _packed(points: DataFrame, rows: int, name: str) -> DataFrame:
    """(name, kinds, ids, x) of blocks of about `rows` of the points (kind, id, e), as bytes."""
    many = int(-(-points.count() // rows) or 1)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "id"])
        return pd.DataFrame([(int(key[0]), pdf["kind"].to_numpy(np.int32).tobytes(), pdf["id"].to_numpy(np.int64).tobytes(), np.stack(pdf["e"].to_list()).astype(float).tobytes())], columns=[name, "kinds", "ids", "x"])

    placed = points.select(F.pmod(F.xxhash64("kind", "id"), F.lit(many)).cast("int").alias(name), "kind", "id", "e")
    return checkpointed(placed.groupBy(name).applyInPandas(pack, f"{name} int, kinds binary, ids binary, x binary"))


class _Nearest:
    """The k nearest points so far of a block of queries, by distance, kind and id."""

    def __init__(self, kind: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.kind, self.ids, self.x, self.k = kind, ids, x, k
        self.wide = np.concatenate([-2 * x, np.ones((len(x), 1)), (x * x).sum(1)[:, None]], axis=1)
        self.d, self.code = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.own = kind.astype(np.int64) << 62 | ids

    def meet(self, kind: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        code = kind.astype(np.int64) << 62 | ids
        worst = self.d.max(axis=1)
        rough = self.wide @ np.concatenate([y, (y * y).sum(1)[:, None], np.ones((len(y), 1))], axis=1).T
        # products are rounded: what may be among the nearest by them is measured by differences
        slack = 1e-9 * (1 + self.wide[:, -1] + float((y * y).sum(1).max(initial=0.0)))
        some = min(self.k, len(y))
        bound = worst + slack
        if not np.isfinite(worst).all() and some < len(y):
            bound = np.minimum(bound, np.partition(rough, min(some, len(y) - 1), axis=1)[:, min(some, len(y) - 1)] + 2 * slack)  # one more, for the query itself
        row, at = np.nonzero(rough <= bound[:, None])
        keep = code[at] != self.own[row]
        row, at = row[keep], at[keep]
        d = np.round(((self.x[row] - y[at]) ** 2).sum(1), DIGITS)
        edge = np.searchsorted(row, np.arange(len(self.x) + 1))
        for i in np.flatnonzero(np.diff(edge)):
            mine = slice(edge[i], edge[i + 1])
            both, codes = np.concatenate([self.d[i], d[mine]]), np.concatenate([self.code[i], code[at[mine]]])
            if len(both) > 2 * self.k:
                near = both <= np.partition(both, self.k - 1)[self.k - 1]
                both, codes = both[near], codes[near]
            first = np.lexsort((codes, both))[: self.k]
            self.d[i], self.code[i] = both[first], codes[first]


class _Kinds:
    """How many of the k nearest points so far of a block of queries are of kind 1; ties in distance go by kind.

    A point is its distance to DIGITS places and its kind in one number. Products in single precision, with more than their rounding as a margin,
    leave out points beyond the k-th distance so far; what they leave is measured by differences.
    """

    def __init__(self, kind: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.x, self.k, self.own = x, k, kind.astype(np.int64) << 62 | ids
        self.norm = (x * x).sum(1)
        self.wide = np.concatenate([-2 * x, np.ones((len(x), 1)), self.norm[:, None]], axis=1).astype(np.float32)
        self.worst = np.full(len(x), np.inf)
        self.keys, self.held = np.full((len(x), k + max(k, COLUMNS)), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

    def meet(self, kind: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        code = kind.astype(np.int64) << 62 | ids
        norm = (y * y).sum(1)
        wide = np.ascontiguousarray(np.concatenate([y, norm[:, None], np.ones((len(y), 1))], axis=1).astype(np.float32).T)
        margin = (y.shape[1] + 8) * 2.0**-22 * (self.norm + norm.max(initial=0.0)) + 10.0**-DIGITS
        for a in range(0, len(self.x), ROWS):
            for b in range(0, len(y), COLUMNS):
                rows, cols = slice(a, a + ROWS), slice(b, b + COLUMNS)
                near = self.wide[rows] @ wide[:, cols] <= (self.worst[rows] + margin[rows]).astype(np.float32)[:, None]
                at = np.flatnonzero(near)
                if len(at):
                    row, col = np.divmod(at, near.shape[1])
                    self._add(row + a, col + b, code, kind, y)

    def _add(self, row: np.ndarray, at: np.ndarray, code: np.ndarray, kind: np.ndarray, y: np.ndarray) -> None:
        apart = self.x[row] - y[at]
        d = np.einsum("ij,ij->i", apart, apart)
        keep = (d <= self.worst[row] + 10.0**-DIGITS) & (code[at] != self.own[row])
        row, at, d = row[keep], at[keep], d[keep]
        if not len(row):
            return
        first = np.flatnonzero(np.diff(row, prepend=-1))
        some, many = row[first], np.diff(np.append(first, len(row)))
        full = some[self.held[some] + many > self.keys.shape[1]]
        if len(full):
            self._cut(full)
        place = np.arange(len(row)) - np.repeat(first, many) + self.held[row]
        self.keys[row, place] = np.rint(np.minimum(d * 10.0**DIGITS, 4e18)).astype(np.int64) * 2 + kind[at]
        self.held[some] += many
        self._cut(some[self.held[some] >= np.where(np.isfinite(self.worst[some]), 1.5 * self.k, self.k)])

    def _cut(self, rows: np.ndarray) -> None:
        """Only the k least of these queries' numbers stay."""
        if not len(rows):
            return
        wide = max(self.k, int(self.held[rows].max()))
        least = np.partition(self.keys[rows, :wide], self.k - 1, axis=1)
        least[:, self.k :] = np.iinfo(np.int64).max
        self.keys[rows, :wide], self.held[rows] = least, np.minimum(self.held[rows], self.k)
        self.worst[rows] = np.where(self.held[rows] == self.k, (least[:, self.k - 1] >> 1) / 10.0**DIGITS, np.inf)

    def found(self) -> np.ndarray:
        self._cut(np.arange(len(self.x)))
        least = self.keys[:, : self.k]
        return ((least & 1 == 1) & (least < np.iinfo(np.int64).max)).sum(axis=1)


def _searched(queries: DataFrame, points: DataFrame, k: int, state: type, result: Callable[[_Nearest | _Kinds, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `result` makes of the `state` of each block of queries (of its ids, too), once all blocks of points have been met.

    Every pair of blocks meets in a task by a cross join of written blocks, which are read, not shuffled; a task holds the nearest points of its own
    blocks of queries and one block of points, and only results leave it. Exact; the work is queries times points, as for any exact search in a space
    where bounds don't prune.
    """
    parallel = queries.sparkSession.sparkContext.defaultParallelism
    size = max(64, min(QUERIES, -(-queries.count() // (2 * parallel))))
    left = _packed(queries, size, "bq").withColumnsRenamed({"kinds": "qk", "ids": "qi", "x": "qx"})
    parts = max(1, min(left.count(), max(2 * parallel, -(-left.count() // HELD))))
    right = _packed(points, POINTS, "bp").coalesce(1)  # all blocks of points pass through each task of queries

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for pdf in it:
            for bq, qk, qi, qx, kinds, ids, x in pdf[["bq", "qk", "qi", "qx", "kinds", "ids", "x"]].itertuples(index=False):
                if bq not in held:
                    ks, own = np.frombuffer(qk, np.int32), np.frombuffer(qi, np.int64)
                    held[bq] = state(ks, own, np.frombuffer(qx).reshape(len(ks), -1), k), own
                kinds = np.frombuffer(kinds, np.int32)
                held[bq][0].meet(kinds, np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(len(kinds), -1))
        for found, own in held.values():
            yield result(found, own)

    pairs = left.repartition(parts).hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.mapInPandas(run, schema)


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(kind, id, near): the k nearest points (d, kind, id) of each query, itself left out, from queries and points (kind, id, e).

    d: squared distance to DIGITS places. Ties go by kind, then id.
    """

    def listed(own: _Nearest, ids: np.ndarray) -> pd.DataFrame:
        near = [[{"d": float(v), "kind": int(c >> 62), "id": int(c & (1 << 62) - 1)} for v, c in zip(d, code) if v < np.inf] for d, code in zip(own.d, own.code)]
        return pd.DataFrame({"kind": own.kind, "id": ids, "near": near})

    return _searched(queries, points, k, _Nearest, listed, "kind int, id long, near array<struct<d: double, kind: int, id: long>>")


def near_kind(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(id, n): how many of the k nearest points of each query are of kind 1; the points themselves leave no task."""
    return _searched(queries, points, k, _Kinds, lambda own, ids: pd.DataFrame({"id": ids, "n": own.found()}), "id long, n long")


def alike(counts: DataFrame, units: DataFrame) -> DataFrame:
    """(pos, first): each unit of `units` (unit, pos) and the least position of the units with the same counts."""
    lists = counts.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("feature", "y"))).alias("ys")).join(units.select("unit", "pos"), "unit")
    same = lists.groupBy("ys").agg(F.min("pos").alias("first"), F.collect_list("pos").alias("each"))
    return same.select(F.explode("each").alias("pos"), "first")


def posterior(frac: Column, rho: float, ratio: float) -> Column:
    """Chance of a doublet from the share of simulated ones around, by the prior rho and simulated units per observed one."""
    odds = F.lit(rho / (1 - rho)) * frac / (1 - frac) / ratio
    return odds / (1 + odds)


def doublet_scores(counts: DataFrame, rho: float = 0.05, per_unit: int = 2, n_hvg: int = 1000, n_pc: int = 15, n_nn: int | None = None, seed: int = 1) -> DataFrame:
    """(unit, frac, score): the share of simulated sums of two units among each unit's neighbours, and the posterior chance of a doublet.

    counts (unit, feature, y) of one dataset. `per_unit` sums are simulated for each unit. All are scaled to the median library, logged and
    put on the n_pc leading components of the n_hvg most variable features of the observed units. Units without a count are not there. No unit: no row.
    """
    counts = counts.select("unit", "feature", "y").where("y > 0")
    units = checkpointed(numbered(counts.select("unit").distinct()))
    n = units.count()
    if n < 2:
        return units.select("unit", F.lit(None).cast("double").alias("frac"), F.lit(None).cast("double").alias("score"))
    n_sim = per_unit * n
    k = n_nn or max(10, round(0.5 * (n + n_sim) ** 0.5))
    depth = counts.groupBy("unit").agg(F.sum("y").alias("l")).agg(F.percentile("l", 0.5)).first()[0]
    seen = checkpointed(log_scaled(counts, "unit", depth))
    sums = log_scaled(simulated(counts, units, n_sim, seed), "id", depth)
    features = checkpointed(most_variable(seen, n, n_hvg))
    turn = components(seen, n, features, n_pc)
    real = embedded(seen, units, "unit", features, turn).join(units.select("unit", "pos"), "unit").select(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("id"), "e")
    false = embedded(sums, counts.sparkSession.range(n_sim), "id", features, turn).select(F.lit(1).alias("kind"), "id", "e")
    points = checkpointed(real.union(false))
    # units with the same counts have the same neighbours, each other included, so one of them is searched for
    groups = checkpointed(alike(counts, units))
    own = points.where("kind = 0").join(groups.select(F.col("first").alias("id")).distinct(), "id", "left_semi").select("kind", "id", "e")
    near = near_kind(own, points, k).select(F.col("id").alias("first"), ((F.col("n") + 0.5) / (k + 1)).alias("frac"))
    scored = near.join(groups, "first").join(units.select("unit", "pos"), "pos")
    return scored.select("unit", "frac", posterior(F.col("frac"), rho, n_sim / n).alias("score"))
