"""Leading eigenvalues of correlation tables in feature blocks, and their null spectra under relabelling and recolouring of units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions.stats import benjamini_hochberg, correlation
from dispersa.operators.resampling import before_cut, first_half, hash_cuts, hash_states, hashed_names, hashed_weights, own_cuts
from dispersa.sources.results import checkpointed

#: Features of a block's side: a task holds blocks, never a table of all pairs.
SIDE = 512

#: Most draws that a task sums up together, units of a block, and bytes of the products that a block gives.
DRAWS_TOGETHER, UNITS_TOGETHER, PRODUCT_BYTES = 128, 4096, 64 << 20

BLOCKS = "key string, bi int, bj int, m binary"


def _slices(p: int, side: int) -> list[slice]:
    return [slice(a, min(a + side, p)) for a in range(0, p, side)]


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


# Eigenvalues ----------------------------------------------------------------------------------------------------------


def pair_blocks(pairs: DataFrame, value: str, diagonal: float = 0.0, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, bi, bj, m), bi <= bj, of one symmetric pair table (i, j, value), and its features (feature, block, at)."""
    names = pairs.select(F.col("i").alias("feature")).union(pairs.select("j")).distinct()
    # blocks follow a hash of the name, so that features are numbered within blocks and never all in one place
    p = names.count()
    many = -(-p // side) or 1
    placed = names.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(many)).cast("int"))
    lists = placed.groupBy("block").agg(F.sort_array(F.collect_list("feature")).alias("fs"))
    gapless = lists.withColumn("block", (F.dense_rank().over(Window.orderBy("block")) - 1).cast("int"))  # a row a block
    placed = checkpointed(gapless.select("block", F.posexplode("fs").alias("at", "feature")))
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
    end = lambda c: placed.select(F.col("feature").alias(c), F.col("block").alias(f"_b{c}"), F.col("at").alias(f"_a{c}"))
    cells = pairs.select("i", "j", F.col(value).cast("double").alias("v")).join(end("i"), "i").join(end("j"), "j")
    swap = F.col("_bi") > F.col("_bj")
    cells = cells.select(
        F.least("_bi", "_bj").alias("bi"), F.greatest("_bi", "_bj").alias("bj"), F.when(swap, F.col("_aj")).otherwise(F.col("_ai")).alias("r"), F.when(swap, F.col("_ai")).otherwise(F.col("_aj")).alias("c"), "v"
    )
    own = placed.select(F.col("block").alias("bi"), F.col("block").alias("bj"), F.col("at").alias("r"), F.col("at").alias("c"), F.lit(float(diagonal)).alias("v"))
    height, width = sizes.select(F.col("block").alias("bi"), F.col("n").alias("h")), sizes.select(F.col("block").alias("bj"), F.col("n").alias("w"))
    cells = cells.union(own).join(height, "bi").join(width, "bj")

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        m = np.zeros((int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])))
        m[pdf["r"], pdf["c"]] = pdf["v"]
        if bi == bj:
            m[pdf["c"], pdf["r"]] = pdf["v"]
        return pd.DataFrame({"key": [""], "bi": [bi], "bj": [bj], "m": [m.tobytes()]})

    return checkpointed(cells.groupBy("bi", "bj").applyInPandas(dense, BLOCKS)), placed


def _times(blocks: DataFrame, panels: DataFrame) -> DataFrame:
    """(key, b, y): for each block the product with the panel (key, b, n, q) of its columns, and of its transpose with that of its rows."""
    across = blocks.select("key", F.col("bi").alias("to"), F.col("bj").alias("b"), "m", F.lit(False).alias("turn"))
    down = blocks.where("bi <> bj").select("key", F.col("bj").alias("to"), F.col("bi").alias("b"), "m", F.lit(True).alias("turn"))
    both = across.union(down).join(panels, ["key", "b"]).select("key", "to", "turn", "n", "m", "q")

    def multiply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            y = [((m.reshape(n, -1).T if turn else m.reshape(-1, n)) @ _matrix(q, n)).tobytes() for turn, n, m, q in ((t, n, np.frombuffer(m), q) for t, n, m, q in zip(pdf["turn"], pdf["n"], pdf["m"], pdf["q"]))]
            yield pd.DataFrame({"key": pdf["key"], "b": pdf["to"], "y": y})

    return both.mapInPandas(multiply, "key string, b int, y binary")


def _extend(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One step of a block Krylov space for a key: the products of its last panel extend the basis; Ritz values of what there is."""
    state = right.iloc[0]
    sizes = np.asarray(state["sizes"], np.int64)
    p, at = int(sizes.sum()), np.cumsum(sizes) - sizes
    basis = _matrix(state["basis"], p)
    last = basis[:, basis.shape[1] - int(state["fresh"]) :]
    product = np.zeros((p, last.shape[1]))
    for b, y in zip(left["b"], left["y"]):
        product[at[b] : at[b] + sizes[b]] += _matrix(y, int(sizes[b]))
    images = np.concatenate([_matrix(state["images"], p), product], axis=1) if len(state["images"]) else product
    ritz, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
    order = np.argsort(-np.abs(ritz), kind="stable")
    more = product.copy()
    for _ in range(2):  # twice, so that what rounding left of the basis goes too
        more -= basis @ (basis.T @ more)
    q, r = np.linalg.qr(more)
    kept = np.abs(np.diag(r)) > 1e-9 * max(1.0, float(np.abs(ritz).max(initial=0.0)))
    fresh = q[:, kept][:, : max(0, p - basis.shape[1])]
    return pd.DataFrame([{
        "key": key[0], "sizes": sizes.tolist(), "basis": np.concatenate([basis, fresh], axis=1).tobytes(), "images": images.tobytes(), "fresh": fresh.shape[1],
        "values": ritz[order].tolist(), "vectors": (basis @ turn[:, order]).tobytes(),
    }])


STATE = "key string, sizes array<int>, basis binary, images binary, fresh int, values array<double>, vectors binary"


def top_eigen(blocks: DataFrame, k: int, tolerance: float = 1e-10, most_rounds: int = 60, seed: int = 3) -> DataFrame:
    """(key, values, vectors, sizes): the eigenvalues largest in magnitude of each key's symmetric matrix, and their vectors.

    blocks (key, bi, bj, m) holds bi <= bj. A round multiplies the blocks with narrow panels, which are joined to them, and extends each
    key's Krylov basis by the sums: a task sees blocks, or one key's panels of as many rows as features. Rounds end when the k leading
    values of all keys stand still, or a basis is complete and the values are exact, or after most_rounds.
    """
    wide = k + 8
    shape = blocks.where("bi = bj").groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("bi", F.sqrt(F.octet_length("m") / 8).cast("int").alias("n")))), lambda x: x["n"]).alias("sizes"))

    def first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, sizes in zip(pdf["key"], pdf["sizes"]):
                p = int(np.sum(sizes))
                q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, min(wide, p))))[0]
                rows.append({"key": key, "sizes": list(sizes), "basis": q.tobytes(), "images": b"", "fresh": q.shape[1], "values": [], "vectors": b""})
            yield pd.DataFrame(rows)

    def panels(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, sizes, basis, fresh in zip(pdf["key"], pdf["sizes"], pdf["basis"], pdf["fresh"]):
                q = _matrix(basis, int(np.sum(sizes)))
                q, at = q[:, q.shape[1] - fresh :], 0
                for b, n in enumerate(sizes):
                    rows.append((key, b, int(n), np.ascontiguousarray(q[at : at + n]).tobytes()))
                    at += n
            yield pd.DataFrame(rows, columns=["key", "b", "n", "q"])

    state = checkpointed(shape.mapInPandas(first, STATE))
    before = None
    for _ in range(most_rounds):
        open_ = state.where("fresh > 0")
        parts = _times(blocks, open_.mapInPandas(panels, "key string, b int, n int, q binary"))
        moved = parts.groupBy("key").cogroup(open_.groupBy("key")).applyInPandas(_extend, STATE)
        state = checkpointed(moved.union(state.where("fresh = 0")))
        now = state.select("key", F.slice("values", 1, k).alias("v"), (F.col("fresh") == 0).alias("done"))
        if before is not None:
            apart = F.aggregate(F.zip_with("v", "w", lambda a, b: F.abs(F.coalesce(F.abs(a), F.lit(0.0)) - F.coalesce(F.abs(b), F.lit(0.0)))), F.lit(0.0), lambda x, y: F.greatest(x, y))
            scale = F.greatest(F.abs(F.col("v")[0]), F.lit(1e-300))
            if now.join(before.select("key", F.col("v").alias("w")), "key").where(~F.col("done") & (apart > tolerance * scale)).isEmpty():
                break
        before = now
    return state.select("key", F.slice("values", 1, k).alias("values"), "vectors", "sizes")


def leading_axes(pairs: DataFrame, value: str, k: int, diagonal: float = 0.0, side: int = SIDE) -> DataFrame:
    """(rank, eigenvalue, share, feature, v): the k axes of a symmetric pair table with the largest |eigenvalue|, at any number of features.

    share: the squared eigenvalue in the sum of all squared entries. The entry of a vector with the largest size is positive, of
    equal ones that of the least name. No pair: no axis.
    """
    blocks, placed = pair_blocks(pairs, value, diagonal, side)
    found = top_eigen(blocks, k)

    def spread(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for values, vectors, sizes in zip(pdf["values"], pdf["vectors"], pdf["sizes"]):
                v = _matrix(vectors, int(np.sum(sizes)))
                block, at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
                for rank, value in enumerate(values):
                    yield pd.DataFrame({"rank": rank + 1, "eigenvalue": value, "block": block, "at": at, "v": v[:, rank]})

    loads = found.mapInPandas(spread, "rank int, eigenvalue double, block int, at int, v double").join(placed, ["block", "at"])
    total = pairs.agg((2 * F.sum(F.col(value) * F.col(value))).alias("t")).join(placed.agg((F.count("*") * float(diagonal) ** 2).alias("d")))
    largest = loads.groupBy("rank").agg(F.max(F.abs("v")).alias("top"))
    near = loads.join(largest, "rank").where(F.abs("v") >= F.col("top") * (1 - 1e-9))  # sizes that differ by rounding alone are equal
    sign = near.groupBy("rank").agg(F.min_by("v", "feature").alias("s"))
    out = loads.join(sign, "rank").join(F.broadcast(total))
    return out.select("rank", "eigenvalue", F.try_divide(F.col("eigenvalue") * F.col("eigenvalue"), F.col("t") + F.col("d")).alias("share"), "feature", (F.col("v") * F.when(F.col("s") < 0, -1.0).otherwise(1.0)).alias("v"))


def rank_fit(pairs: DataFrame, value: str, axes: DataFrame, k: int) -> DataFrame:
    """(k, r2): squared correlation of the pairs' values with those that the first k axes give back; null if either is constant."""
    loads = axes.where(F.col("rank") <= k).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("eigenvalue", "v")))).alias("x"))
    a, b = loads.select(F.col("feature").alias("i"), F.col("x").alias("a")), loads.select(F.col("feature").alias("j"), F.col("x").alias("b"))
    both = pairs.select("i", "j", F.col(value).alias("seen")).join(a, "i").join(b, "j")
    terms = F.transform(F.map_keys("a"), lambda r: F.col("a")[r]["eigenvalue"] * F.col("a")[r]["v"] * F.col("b")[r]["v"])
    back = both.withColumn("back", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))
    return back.agg(F.lit(k).alias("k"), F.pow(correlation("seen", "back"), F.lit(2)).alias("r2"))


# Null spectra ---------------------------------------------------------------------------------------------------------


def unit_vectors(residuals: DataFrame, views: list[str]) -> DataFrame:
    """(unit, x0, x1): a unit's residuals over all features in order of their names, in one view or in two."""
    named = residuals.where(F.col("dataset").isin(*views))
    if "x" not in residuals.columns:  # a row a feature, else vectors as coexpression.residual_vectors gives them
        named = named.groupBy("dataset", "unit").agg(F.sort_array(F.collect_list(F.struct("feature", "r"))).alias("x")).select("dataset", "unit", F.col("x.r").alias("x"))
    if len(views) == 1:
        return named.select("unit", F.col("x").alias("x0"))
    wide = named.groupBy("unit").agg(*[F.max(F.when(F.col("dataset") == v, F.col("x"))).alias(f"x{i}") for i, v in enumerate(views)])
    return wide.where(" AND ".join(f"x{i} IS NOT NULL" for i in range(len(views))))


def relabelled_units(parents: tuple[DataFrame, DataFrame], alleles: DataFrame, draws: int, seed: int, label=None) -> DataFrame:
    """(grp, block, db, low, unit, x0, x1, flags): units with their flags in a block of draws from `low` on, draw 0 the data as they are.

    grp 0: pooled parents; flagged units form the half of the first parent's size, those of the least hashes in a draw. grp 1: hybrid units;
    a flag swaps the two alleles. Flags follow from a unit's own hashes and the cuts of the draws, so no table of units and draws is shuffled.
    """
    a, b = (df.select("unit", "x0").withColumn("first", F.lit(i == 0)) for i, df in enumerate(parents))
    pool = checkpointed(a.union(b).withColumn("id", F.concat(F.col("first").cast("string"), F.lit(":"), "unit")))
    alleles = checkpointed(alleles.select("unit", "x0", "x1"))
    sized = pool.agg(F.count("*").alias("n"), F.count_if("first").alias("first_n"), F.coalesce(F.max(F.size("x0")), F.lit(0)).alias("p")).first()
    wide = int(max(1, min(DRAWS_TOGETHER, PRODUCT_BYTES // (16 * max(sized.p, 1) ** 2))))
    hashed = lambda d, u: label(d, u) if label else F.xxhash64(F.lit(seed), d, u)
    own = F.lit("").alias("pool")
    cuts = hash_cuts(pool.select(own, F.col("id").alias("item")), pool.sparkSession.createDataFrame([("", sized.first_n)], "pool string, first_n long"), draws, lambda _, d, u: hashed(d, u))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(-(-n // UNITS_TOGETHER) or 1)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(draws // wide))).alias("db")
    low = F.col("db") * wide
    inside = F.sequence(low, F.least(low + wide - 1, F.lit(draws)))
    at = lambda grp, b, unit, x1, flags: (F.lit(grp).alias("grp"), b, "db", low.alias("low"), unit, "x0", x1, flags.alias("flags"))
    halves = pool.select("id", "x0", "first", own, every).join(F.broadcast(cuts), "pool", "left")
    flags = F.transform(inside, lambda d: F.when(d == 0, F.col("first")).otherwise(before_cut(F.col("hs"), F.col("ids"), d, hashed(d, F.col("id")), F.col("id"))))
    halves = halves.select(*at(0, block("id", sized.n), F.col("id").alias("unit"), F.array().cast("array<double>").alias("x1"), flags))
    swap = lambda d: F.when(d == 0, F.lit(False)).otherwise((label(d, F.col("unit")) if label else F.xxhash64(F.lit(seed + 1), d, "unit")) % 2 != 0)
    both = alleles.select("*", every)
    both = both.select(*at(1, block("unit", alleles.count()), F.col("unit"), F.col("x1"), F.transform(inside, swap)))
    return checkpointed(halves.union(both))


def _halves(x0: np.ndarray, x1: np.ndarray, flags: np.ndarray, grp: int) -> tuple[np.ndarray, np.ndarray]:
    if grp == 0:
        return x0[flags], x0[~flags]
    return np.where(flags[:, None], x1, x0), np.where(flags[:, None], x0, x1)


def _loaded(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grp, low = int(pdf["grp"].iloc[0]), int(pdf["low"].iloc[0])
    x0, flags = np.stack(pdf["x0"].to_list()), np.stack(pdf["flags"].to_list()).astype(bool)
    x1 = np.stack(pdf["x1"].to_list()) if grp else x0
    return grp, low + np.arange(flags.shape[1]), x0, x1, flags


def _sums(side: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums of powers and products of one block of units in each draw and half."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, draws, x0, x1, flags = _loaded(pdf)
        parts, rows = _slices(x0.shape[1], side), []
        up = [np.concatenate([np.ones_like(x), x, x * x, x * x * x, (x * x) ** 2], axis=1) for x in ([x0, x1] if grp else [x0])]
        on, off = flags.T.astype(float), (~flags).T.astype(float)
        powers = (on @ up[-1] + off @ up[0], on @ up[0] + off @ up[-1]) if grp else (on @ up[0], off @ up[0])
        for i, draw in enumerate(draws.tolist()):
            for half, x in enumerate(_halves(x0, x1, flags[:, i], grp)):
                rows.append((draw, grp, half, -1, -1, powers[half][i].tobytes()))
                for bi, s in enumerate(parts):
                    rows += [(draw, grp, half, bi, bj, (x[:, s].T @ x[:, t]).tobytes()) for bj, t in enumerate(parts) if bj >= bi]
        return pd.DataFrame(rows, columns=["draw", "grp", "half", "bi", "bj", "m"])

    return run


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(m) for m in pdf["m"]], axis=0)
    return pd.DataFrame([(*key, total.tobytes())], columns=["draw", "grp", "half", "bi", "bj", "m"])


def _spread_of(powers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Units, means, inverse standard deviations (0 for a constant) and the sum of fourth powers of the standardised values."""
    n, s1, s2, s3, s4 = powers[0, 0], *powers[1:]
    m = s1 / n
    v = (s2 - n * m * m) / (n - 1)
    inverse = np.where(v > 1e-12 * np.maximum(1.0, s2 / n), 1 / np.sqrt(np.where(v > 0, v, 1.0)), 0.0)
    fourth = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * n * m**4
    return float(n), m, inverse, float((inverse**4 * fourth).sum())


def _squares(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums over units of the squared norm of their standardised values, squared, for each draw and half."""
    if not len(left) or not len(right):
        return pd.DataFrame(columns=["draw", "grp", "half", "q"])
    grp, draws, x0, x1, flags = _loaded(left)
    known = {(d, h): np.frombuffer(m).reshape(5, -1) for d, h, m in zip(right["draw"], right["half"], right["m"])}
    rows = []
    for i, draw in enumerate(draws.tolist()):
        for half, x in enumerate(_halves(x0, x1, flags[:, i], grp)):
            _, m, inverse, _ = _spread_of(known[draw, half])
            z = ((x - m) * inverse) ** 2
            rows.append((draw, grp, half, float((z.sum(1) ** 2).sum())))
    return pd.DataFrame(rows, columns=["draw", "grp", "half", "q"])


def null_blocks(units: DataFrame, side: int = SIDE) -> DataFrame:
    """(draw, part, bi, bj, m): differences total, cis and trans of the halves' shrunken correlations in each draw, diagonal 0.

    Off-diagonals are shrunk by lambda = sum var(r) / sum r^2 within 0..1. The variances' sum over all pairs follows from a number a unit, the
    squared norm of its standardised values, so it takes a second pass over units instead of products of squares.
    """
    summed = units.groupBy("grp", "block", "db").applyInPandas(_sums(side), "draw int, grp int, half int, bi int, bj int, m binary")
    summed = checkpointed(summed.groupBy("draw", "grp", "half", "bi", "bj").applyInPandas(_added, "draw int, grp int, half int, bi int, bj int, m binary"))
    powers = summed.where("bi = -1").select("draw", "grp", "half", "m")
    where = units.select("grp", "block", "db", "low", F.size("flags").alias("n")).distinct().select("grp", "block", "db", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias("draw"))
    known = powers.join(where, ["grp", "draw"]).select(*[F.col(c).alias(c) for c in ("grp", "block", "db", "draw", "half", "m")])
    norms = units.groupBy("grp", "block", "db").cogroup(known.groupBy("grp", "block", "db")).applyInPandas(_squares, "draw int, grp int, half int, q double")
    norms = norms.groupBy("draw", "grp", "half").agg(F.sum("q").alias("q"))
    grams = summed.where("bi >= 0").join(powers.withColumnRenamed("m", "w"), ["draw", "grp", "half"])

    def correlate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for draw, grp, half, bi, bj, m, w in pdf[["draw", "grp", "half", "bi", "bj", "m", "w"]].itertuples(index=False):
                n, mean, inverse, four = _spread_of(np.frombuffer(w).reshape(5, -1))
                parts = _slices(len(mean), side)
                s, t = parts[bi], parts[bj]
                g = np.frombuffer(m).reshape(s.stop - s.start, t.stop - t.start)
                r = (g - n * np.outer(mean[s], mean[t])) * np.outer(inverse[s], inverse[t]) / (n - 1)
                if bi == bj:
                    np.fill_diagonal(r, 0.0)
                rows.append((draw, grp, half, bi, bj, n, four, float((r * r).sum()) / (2 if bi == bj else 1), r.tobytes()))
            yield pd.DataFrame(rows, columns=["draw", "grp", "half", "bi", "bj", "n", "four", "den", "r"])

    cells = checkpointed(grams.mapInPandas(correlate, "draw int, grp int, half int, bi int, bj int, n double, four double, den double, r binary"))
    n, den = F.col("n"), F.col("den")
    num = n / F.pow(n - 1, F.lit(3)) * ((F.col("q") - F.col("four")) / 2 - (n - 1) * (n - 1) / n * den)
    lam = cells.groupBy("draw", "grp", "half").agg(F.first("n").alias("n"), F.first("four").alias("four"), F.sum("den").alias("den")).join(norms, ["draw", "grp", "half"])
    lam = lam.select("draw", "grp", "half", F.when(den > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den))).otherwise(1.0).alias("lam"))
    sides = cells.select("draw", "grp", "half", "bi", "bj", "r").join(lam, ["draw", "grp", "half"])

    def contrast(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        draw, bi, bj = key
        total, cis = (sum((1 if h == 0 else -1) * (1 - lam) * np.frombuffer(r) for h, lam, r in zip(p["half"], p["lam"], p["r"])) for p in (pdf[pdf["grp"] == g] for g in (0, 1)))
        return pd.DataFrame([(draw, part, bi, bj, np.asarray(m).tobytes()) for part, m in (("total", total), ("cis", cis), ("trans", total - cis))], columns=["draw", "part", "bi", "bj", "m"])

    return checkpointed(sides.groupBy("draw", "bi", "bj").applyInPandas(contrast, "draw int, part string, bi int, bj int, m binary"))


def spectra(blocks: DataFrame, k: int) -> DataFrame:
    """(draw, part, rank, value): the k largest squared eigenvalues of each draw's parts, from null_blocks."""
    keyed = blocks.select(F.concat(F.col("draw").cast("string"), F.lit(":"), "part").alias("key"), "bi", "bj", "m")
    found = top_eigen(keyed, k).select(F.split("key", ":").alias("x"), F.posexplode("values").alias("rank", "v"))
    return found.select(F.col("x")[0].cast("int").alias("draw"), F.col("x")[1].alias("part"), (F.col("rank") + 1).alias("rank"), (F.col("v") * F.col("v")).alias("value"))


def _relabelled_sums(it: Iterator[pd.DataFrame], draws: int, seed: int, cut: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pd.DataFrame]:
    """Sums of all products of two of 1, x and x^2 (a triangle, row by row) over both halves of each group in draws 0 to `draws`."""
    held, states = {}, {0: hash_states(seed, range(1, draws + 1)), 1: hash_states(seed + 1, range(1, draws + 1))}

    def products(rows: list) -> np.ndarray:
        x = np.stack(rows)
        v = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
        return np.concatenate([v[:, j : j + 1] * v[:, j:] for j in range(v.shape[1])], axis=1)

    for pdf in it:
        for grp, own in pdf.groupby("grp", sort=False):
            for a in range(0, len(own), DRAWS_TOGETHER * 4):
                rows = own.iloc[a : a + DRAWS_TOGETHER * 4]
                names = [x.encode() for x in rows["id"]]
                if grp == 0:
                    flags = np.concatenate([rows["first"].to_numpy(bool)[:, None], first_half(names, states[0], cut)], axis=1)
                    sums = products(rows["x0"].to_list())
                    one = flags.T.astype(float) @ sums
                    both = sums.sum(axis=0)
                else:
                    flags = np.concatenate([np.zeros((len(rows), 1), bool), (hashed_names(names, states[1]) & 1 == 1).T], axis=1)
                    sums, other = products(rows["x0"].to_list()), products(rows["x1"].to_list())
                    one = sums.sum(axis=0) + flags.T.astype(float) @ (other - sums)
                    both = sums.sum(axis=0) + other.sum(axis=0)
                if grp in held:
                    held[grp][0] += one
                    held[grp][1] += both
                else:
                    held[grp] = [one, both]
    for grp, (one, both) in held.items():
        yield pd.DataFrame({"draw": np.arange(draws + 1), "grp": grp, "a": [x.tobytes() for x in one], "b": [(both - x).tobytes() for x in one]})


def hashed_spectra(parents: tuple[DataFrame, DataFrame], alleles: DataFrame, draws: int, k: int, seed: int) -> DataFrame:
    """spectra(null_blocks(relabelled_units(..))) for few features, without a row of a unit and a draw.

    A task labels its units in all draws by their hashes and the draws' cuts, and returns the sums of both halves that correlations, lambdas and
    their differences follow from: a number a draw and two products of features, whatever the number of units.
    """
    a, b = (df.select("unit", "x0").withColumn("first", F.lit(i == 0)) for i, df in enumerate(parents))
    none = F.array().cast("array<double>").alias("x1")
    pool = a.union(b).select(F.lit(0).alias("grp"), F.concat(F.col("first").cast("string"), F.lit(":"), "unit").alias("id"), "first", "x0", none)
    units = pool.union(alleles.select(F.lit(1), F.col("unit"), F.lit(False), "x0", "x1"))
    units = checkpointed(units.repartition(units.sparkSession.sparkContext.defaultParallelism, "grp", "id"))
    sized = units.where("grp = 0").agg(F.count("*").alias("n"), F.count_if("first").alias("first_n")).first()
    items = units.where("grp = 0").select(F.lit("").alias("pool"), F.col("id").alias("item"))
    cut = own_cuts(items, {"": (sized.n, sized.first_n)}, draws, lambda _: hash_states(seed, range(1, draws + 1)))[""]
    summed = units.mapInPandas(lambda it: _relabelled_sums(it, draws, seed, cut), "draw int, grp int, a binary, b binary")

    def values(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        half = lambda grp, c: _from_sums(np.sum([np.frombuffer(m) for m in pdf[c][pdf["grp"] == grp]], axis=0))
        if len(set(pdf["grp"])) < 2:
            return pd.DataFrame(columns=["draw", "part", "rank", "value"])
        total, cis = half(0, "a") - half(0, "b"), half(1, "a") - half(1, "b")
        out = []
        for part, m in (("total", total), ("cis", cis), ("trans", total - cis)):
            found = np.sort(np.linalg.eigvalsh(m) ** 2)[::-1][:k]
            out.append(pd.DataFrame({"draw": key[0], "part": part, "rank": np.arange(1, len(found) + 1), "value": found}))
        return pd.concat(out, ignore_index=True)

    return summed.groupBy("draw").applyInPandas(values, "draw int, part string, rank int, value double")


def permutation_spectra(residuals: DataFrame, draws: int, k: int = 15, seed: int = 1, side: int = SIDE) -> DataFrame:
    """(draw, part, rank, value) of permutation nulls of total, cis and trans; draw 0 is what was observed.

    residuals (dataset, unit, feature, r), or vectors (dataset, unit, x), of both parents and both alleles on all features; a hybrid unit needs both
    alleles. Up to a size of sums (2 PRODUCT_BYTES for all draws) by hashed_spectra, beyond by blocks of features.
    """
    residuals = checkpointed(residuals)
    parents, alleles = tuple(unit_vectors(residuals, [v]) for v in ("MIX.SC", "MIX.SE")), unit_vectors(residuals, ["HYB.SC", "HYB.SE"])
    p = alleles.select(F.size("x0").alias("p")).first()
    if p and (draws + 1) * (2 * p.p + 1) * (2 * p.p + 2) * 4 <= 2 * PRODUCT_BYTES:
        return hashed_spectra(parents, alleles, draws, k, seed)
    return spectra(null_blocks(relabelled_units(parents, alleles, draws, seed), side), k)


# Recolouring ----------------------------------------------------------------------------------------------------------


def matrix_power(m: np.ndarray, power: float, least: float = 1e-8, ridge: float = 1e-6) -> np.ndarray:
    """A power of a symmetric positive definite matrix; a ridge is added if its least eigenvalue is too small."""
    values, vectors = np.linalg.eigh(m)
    if values.min() <= least:
        values = values + ridge
    if values.min() <= 0:
        raise ValueError("the matrix isn't positive definite, even with a ridge")
    return (vectors * values**power) @ vectors.T


def recolouring(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrix that turns vectors of correlation `own` into vectors of correlation `target`."""
    return matrix_power(own, -0.5) @ matrix_power(target, 0.5)


def pooled_targets(parent: np.ndarray, hybrid: np.ndarray, n_parent: float, n_hybrid: float, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Correlations under equal structure: of the parent, of the hybrid so that it equals the parent's after scaling, and the
    number of the hybrid's eigenvalues that had to be raised to make it positive."""
    ff = np.outer(factors, factors)
    scaled = hybrid * ff
    np.fill_diagonal(scaled, 1.0)
    pooled = (n_parent * parent + n_hybrid * scaled) / (n_parent + n_hybrid)
    own = (pooled - np.diag(1 - factors**2)) / ff
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    raised = np.maximum(values, 1e-6)
    own = (vectors * raised) @ vectors.T
    d = np.sqrt(np.diag(own))
    return pooled, own / np.outer(d, d), int((values < 1e-6).sum())


def _shrunken(n: float, mean: np.ndarray, inverse: np.ndarray, gram: np.ndarray, four: float, q: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Sample correlation, its shrunken form and lambda from sums over units."""
    r = (gram - n * np.outer(mean, mean)) * np.outer(inverse, inverse) / (n - 1)
    np.fill_diagonal(r, 1.0)
    den = float((np.triu(r, 1) ** 2).sum())
    lam = min(1.0, max(0.0, n / (n - 1) ** 3 * ((q - four) / 2 - (n - 1) ** 2 / n * den) / den)) if den > 0 else 1.0
    shrunk = r * (1 - lam)
    np.fill_diagonal(shrunk, 1.0)
    return r, shrunk, lam


def _group_sums(vectors: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(n, means, inverse deviations, products, fourth powers, squared norms) of a group of unit vectors, by two passes of partial sums."""

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = gram = None
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["x0"].to_list())
                add = np.stack([(x**e).sum(0) for e in range(5)]), x.T @ x
                powers, gram = add if powers is None else (powers + add[0], gram + add[1])
        if powers is not None:
            yield pd.DataFrame({"bi": [0, 1], "m": [powers.tobytes(), gram.tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bi": [key[0]], "m": [np.sum([np.frombuffer(m) for m in pdf["m"]], axis=0).tobytes()]})

    got = {r.bi: np.frombuffer(bytes(r.m)) for r in vectors.select("x0").mapInPandas(partial, "bi int, m binary").groupBy("bi").applyInPandas(add, "bi int, m binary").collect()}
    n, mean, inverse, four = _spread_of(got[0].reshape(5, -1))

    def norms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                z = ((np.stack(pdf["x0"].to_list()) - mean) * inverse) ** 2
                yield pd.DataFrame({"q": [float((z.sum(1) ** 2).sum())]})

    q = vectors.select("x0").mapInPandas(norms, "q double").agg(F.sum("q")).first()[0]
    return n, mean, inverse, got[1].reshape(len(mean), -1), four, float(q)


def recoloured(parent: DataFrame, hybrid: DataFrame, factors: list[float]) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Unit vectors (unit, x0) of both groups under the null that their correlations are equal on the scale of one genome, and figures.

    Each group keeps its own units: they are standardised, whitened by their own correlation and coloured by the pooled one. The
    tables of all pairs of features, as few as a test of axes is for, are worked on by the driver; units are turned by tasks.
    """
    f = np.asarray(factors, float)
    a, b = _group_sums(parent), _group_sums(hybrid)
    (ra, sa, la), (rb, sb, lb) = (_shrunken(*x) for x in (a, b))
    pooled, own, raised = pooled_targets(sa, sb, a[0], b[0], f)

    def turned(df: DataFrame, sums: tuple, turn: np.ndarray) -> DataFrame:
        mean, inverse = sums[1], sums[2]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                if len(pdf):
                    z = (np.stack(pdf["x0"].to_list()) - mean) * inverse
                    yield pd.DataFrame({"unit": pdf["unit"], "x0": list(z @ turn)})

        return df.select("unit", "x0").mapInPandas(run, "unit string, x0 array<double>")

    up = np.triu_indices(len(f), 1)
    figures = {"raised": raised, "lambda_parent": la, "lambda_hybrid": lb, "rms_target": float(np.sqrt((pooled[up] ** 2).mean()))}
    return turned(parent, a, recolouring(ra, pooled)), turned(hybrid, b, recolouring(rb, own)), figures


def recoloured_spectra(parent: DataFrame, hybrid: DataFrame, weights: DataFrame, factors: list[float], k: int = 15, part: str = "par") -> DataFrame:
    """(draw, part, rank, value): squared eigenvalues of hybrid minus parent over resamples within the recoloured groups.

    parent, hybrid (unit, x0) as recoloured() returns them; weights (draw, grp, unit, w) with grp 0 for the parent and 1 for the hybrid.
    """
    f = np.asarray(factors, float)
    rows = parent.select(F.lit(0).alias("grp"), "unit", "x0").union(hybrid.select(F.lit(1).alias("grp"), "unit", "x0")).join(weights, ["grp", "unit"])

    def draw_values(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for g in (0, 1):
            own = pdf[pdf["grp"] == g]
            x, w = np.stack(own["x0"].to_list()), own["w"].to_numpy(float)
            powers = np.stack([(w[:, None] * x**e).sum(0) for e in range(5)])
            n, mean, inverse, four = _spread_of(powers)
            z = ((x - mean) * inverse) ** 2
            tables.append(_shrunken(n, mean, inverse, (x * w[:, None]).T @ x, four, float((w * z.sum(1) ** 2).sum()))[1])
        h = tables[1] * np.outer(f, f)
        np.fill_diagonal(h, 1.0)
        values = np.linalg.eigvalsh(h - tables[0])
        values = np.sort(values**2)[::-1][:k]
        return pd.DataFrame({"draw": key[0], "part": part, "rank": np.arange(1, len(values) + 1), "value": values})

    return rows.select("draw", "grp", "unit", "x0", "w").groupBy("draw").applyInPandas(draw_values, "draw int, part string, rank int, value double")


def _pair_sums(key: tuple, pdf: pd.DataFrame, draws: int, seed: int, wide: int) -> pd.DataFrame:
    """Weighted sums of 1, x, x^2 and of all products of two of x and x^2 over a block of a group's units, in a block of draws."""
    grp, low, n = int(key[0]), int(key[2]) * wide + 1, int(pdf["n"].iloc[0])
    x, at = np.stack(pdf["x0"].to_list()), pdf["pos"].to_numpy(np.int64)
    inside = range(low, min(low + wide, draws + 1))
    w = np.empty((len(inside), len(at)), np.int32)
    for i, own in enumerate(hashed_weights(seed, inside, n)):
        w[i] = own[at]
    v = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
    size = v.shape[1]
    out = np.zeros((len(inside), size * (size + 1) // 2))
    for a in range(0, len(x), UNITS_TOGETHER):
        part, own, col = v[a : a + UNITS_TOGETHER], w[:, a : a + UNITS_TOGETHER].astype(float), 0
        for j in range(size):
            out[:, col : col + size - j] += own @ (part[:, j : j + 1] * part[:, j:])
            col += size - j
    return pd.DataFrame({"draw": list(inside), "grp": grp, "m": [r.tobytes() for r in out]})


def _from_sums(raw: np.ndarray) -> np.ndarray:
    """Shrunken correlation from the sums of _pair_sums; squared norms of standardised values are a polynomial in them."""
    size = int((8 * len(raw) + 1) ** 0.5) // 2
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = raw
    m = m + np.triu(m, 1).T
    p = (size - 1) // 2
    one, two = slice(1, p + 1), slice(p + 1, size)
    n, mean, inverse, four = _spread_of(np.stack([np.full(p, m[0, 0]), m[0, one], m[0, two], np.diag(m[one, two]), np.diag(m[two, two])]))
    a = inverse**2
    b = a * mean
    c = float(b @ mean)
    q = a @ m[two, two] @ a + 4 * (b @ m[one, one] @ b) + c * c * n - 4 * (a @ m[two, one] @ b) + 2 * c * (a @ m[0, two]) - 4 * c * (b @ m[0, one])
    return _shrunken(n, mean, inverse, m[one, one], four, float(q))[1]


def hashed_recoloured_spectra(parent: DataFrame, hybrid: DataFrame, placed: DataFrame, draws: int, seed: int, factors: list[float], k: int = 15, part: str = "par") -> DataFrame:
    """recoloured_spectra for draws 1 to `draws` of bootstrap.unit_draws with hashed_pick, without a table of units and draws.

    placed (grp, unit, pos, n) numbers the units of each group, 0 for the parent and 1 for the hybrid. A task finds the weights of a block of
    units in a block of draws by the hash and returns sums; both blocks are bounded, and so is what is shuffled after the units themselves.
    """
    f = np.asarray(factors, float)
    size = 2 * len(f) + 1
    wide = int(max(1, min(2 * DRAWS_TOGETHER, PRODUCT_BYTES // (4 * size * (size + 1)))))
    together = max(UNITS_TOGETHER, PRODUCT_BYTES // (16 * size))
    rows = parent.select(F.lit(0).alias("grp"), "unit", "x0").union(hybrid.select(F.lit(1).alias("grp"), "unit", "x0"))
    rows = rows.join(placed.select("grp", "unit", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n")), ["grp", "unit"])
    rows = rows.select("grp", (F.col("pos") / together).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // wide))).alias("db"), "pos", "n", "x0")
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "grp", "block", "db").groupBy("grp", "block", "db")
    summed = dealt.applyInPandas(lambda key, pdf: _pair_sums(key, pdf, draws, seed, wide), "draw int, grp int, m binary")

    def draw_values(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = [_from_sums(np.sum([np.frombuffer(m) for m in pdf["m"][pdf["grp"] == g]], axis=0)) for g in (0, 1)]
        h = tables[1] * np.outer(f, f)
        np.fill_diagonal(h, 1.0)
        values = np.sort(np.linalg.eigvalsh(h - tables[0]) ** 2)[::-1][:k]
        return pd.DataFrame({"draw": key[0], "part": part, "rank": np.arange(1, len(values) + 1), "value": values})

    return summed.groupBy("draw").applyInPandas(draw_values, "draw int, part string, rank int, value double")


def spectrum_p(values: DataFrame, nulls: DataFrame) -> DataFrame:
    """(part, rank, value, p): add-one p of the observed squared eigenvalues against the null draws' of the same rank."""
    seen = values.select("part", "rank", F.col("value").alias("obs"))
    rows = seen.join(nulls.select("part", "rank", "value"), ["part", "rank"], "left")
    return rows.groupBy("part", "rank", F.col("obs")).agg(((1 + F.count_if(F.col("value") >= F.col("obs"))) / (1 + F.count("value"))).alias("p")).withColumnRenamed("obs", "value")


def validated_axes(tests: DataFrame, candidates: DataFrame, sig: float = 0.05) -> DataFrame:
    """(part, rank, value, p, q, validated): rank-matched tests of the candidate axes (part, rank), q by Benjamini-Hochberg within a part's candidates."""
    chosen = tests.join(candidates.select("part", "rank").distinct(), ["part", "rank"], "left_semi")
    return benjamini_hochberg(chosen, "p", ["part"]).select("part", "rank", "value", "p", "q", (F.col("q") < sig).alias("validated"))
