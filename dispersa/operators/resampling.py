"""Resampling of units: bootstrap weights, relabelings, p-values and curve summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispersa.sources.results import checkpointed

#: Slots of a stratum that are drawn together, and positions of draws that a task counts.
SLOTS, COUNTED = 20_000, 500_000


def hashed_pick(seed: int, draw: Column, slot: Column, n: Column) -> Column:
    """A position in 0..n - 1 for a slot of a draw, by hash alone: the same under any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), draw, slot), n)


#: Multipliers of XXH64, by which F.xxhash64 hashes; hashed_weights does the same in a task.
_XXH = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_MASK = (1 << 64) - 1


def _xxh_int(x: int, seed: int) -> int:
    h = (seed + _XXH[4] + 4 & _MASK) ^ (x & 0xFFFFFFFF) * _XXH[0] & _MASK
    h = ((h << 23 | h >> 41) & _MASK) * _XXH[1] + _XXH[2] & _MASK
    h = (h ^ h >> 33) * _XXH[1] & _MASK
    h = (h ^ h >> 29) * _XXH[2] & _MASK
    return h ^ h >> 32


def hashed_weights(seed: int, draws: Iterable[int], n: int) -> Iterator[np.ndarray]:
    """How often each position 0..n - 1 is in each draw of n: the counts of hashed_pick over all slots; draw 0 holds each position once."""
    one, two, three, four, _ = (np.uint64(x) for x in _XXH)
    slots = np.arange(n, dtype=np.uint64) * two
    slots = (slots << np.uint64(31) | slots >> np.uint64(33)) * one
    for draw in draws:
        if draw == 0:
            yield np.ones(n, np.int64)
            continue
        start = np.uint64(_xxh_int(draw, _xxh_int(seed, 42)) + _XXH[4] + 8 & _MASK)
        out = np.zeros(n, np.int64)
        for low in range(0, n, SLOTS):
            h = slots[low : low + SLOTS] ^ start
            h = (h << np.uint64(27) | h >> np.uint64(37)) * one + four
            h = (h ^ h >> np.uint64(33)) * two
            h = (h ^ h >> np.uint64(29)) * three
            picked = (h ^ h >> np.uint64(32)).view(np.int64) % n
            if n > SLOTS:
                np.add.at(out, picked, 1)
            else:
                out += np.bincount(picked, minlength=n)
        yield out


def bootstrap_weights(strata: DataFrame, draws: int, seed: int, pick=hashed_pick) -> DataFrame:
    """(draw, stratum, pos, w): how often each position 0..n - 1 of a stratum (stratum, n) is in a draw of n with replacement."""
    # runs of slots are dealt out and positions are counted by as many tasks as their number asks for
    strata = checkpointed(strata.where("n > 0").select("stratum", F.col("n").cast("long").alias("n")))
    total = strata.agg(F.sum("n")).first()[0] or 0
    parts = max(strata.sparkSession.sparkContext.defaultParallelism, -(-total * draws // COUNTED))
    runs = strata.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long"))).alias("low"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).repartition(min(parts, 1000), "stratum", "low", "draw")
    each = runs.select("stratum", "n", "draw", F.explode(F.sequence("low", F.least(F.col("low") + SLOTS, F.col("n")) - 1)).alias("slot"))
    picked = each.select("draw", "stratum", pick(seed, F.col("draw"), F.col("slot"), F.col("n")).alias("pos"))
    return picked.repartition(parts, "draw", "stratum", "pos").groupBy("draw", "stratum", "pos").agg(F.count("*").alias("w"))


def hash_cuts(items: DataFrame, sizes: DataFrame, draws: int, hashed: Callable[[Column, Column, Column], Column], shift: int = 52) -> DataFrame:
    """(pool, hs, ids): for draws 1 to `draws` the last item of a pool's first half, by hash and then by name; null where the half is empty.

    items (pool, item), sizes (pool, first_n): the items of the least hashes in a draw are its first half. Hashes are counted in buckets, and
    only the bucket that holds the last item is put in order, so no label is stored and no task orders a pool. shift: bits that a bucket leaves out.
    """
    each = items.join(F.broadcast(sizes), "pool").select("pool", "item", "first_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    each = each.withColumn("h", hashed(F.col("pool"), F.col("draw"), F.col("item"))).withColumn("bucket", F.shiftright("h", shift))
    counted = each.groupBy("pool", "draw", "bucket").agg(F.count("*").alias("n"), F.first("first_n").alias("first_n"))
    until = F.sum("n").over(Window.partitionBy("pool", "draw").orderBy("bucket"))
    last = counted.withColumn("until", until).where("until >= first_n AND until - n < first_n")
    last = checkpointed(last.select("pool", "draw", "bucket", (F.col("first_n") - F.col("until") + F.col("n")).alias("at")))  # a row a pool and draw
    inside = each.join(F.broadcast(last), ["pool", "draw", "bucket"])
    order = Window.partitionBy("pool", "draw").orderBy("h", "item")
    cut = inside.withColumn("r", F.row_number().over(order)).where("r = at").groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("draw", F.struct("h", "item")))).alias("m"))
    every = F.sequence(F.lit(1), F.lit(draws))
    return checkpointed(cut.select("pool", F.transform(every, lambda d: F.col("m")[d]["h"]).alias("hs"), F.transform(every, lambda d: F.col("m")[d]["item"]).alias("ids")))


#: Hashes that are worked on together, so that they stay in a core's cache.
HASHES = 1 << 15


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def hashed_names(names: list[bytes], states: np.ndarray) -> np.ndarray:
    """(states x names): F.xxhash64 of each string after what has been hashed to each state, as signed numbers."""
    one, two, three, four, five = (np.uint64(x) for x in _XXH)
    out, sizes = np.empty((len(states), len(names)), np.uint64), np.array([len(x) for x in names], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(names[i] for i in at), np.uint8).reshape(len(at), size)
        words = np.ascontiguousarray(raw[:, : size // 8 * 8]).view("<u8")
        rest = raw[:, size // 8 * 8 :]
        half = np.ascontiguousarray(rest[:, :4]).view("<u4")[:, 0].astype(np.uint64) * one if rest.shape[1] >= 4 else None
        single = rest[:, 4 if half is not None else 0 :].astype(np.uint64) * five
        striped = words.shape[1] // 4 * 4
        mixed = _turned(words[:, striped:] * two, 31) * one
        step = max(1, HASHES // len(at))
        for low in range(0, len(states), step):
            state = states[low : low + step, None]
            if striped:
                v = [state + one + two, state + two, state + np.uint64(0), state - one]
                for j in range(striped):
                    v[j % 4] = _turned(v[j % 4] + words[None, :, j] * two, 31) * one
                h = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
                for x in v:
                    h = (h ^ _turned(x * two, 31) * one) * one + four
                h += np.uint64(size)
            else:
                h = np.broadcast_to(state + five + np.uint64(size), (len(state), len(at))).copy()
            for j in range(mixed.shape[1]):
                h ^= mixed[None, :, j]
                h = _turned(h, 27)
                h *= one
                h += four
            if half is not None:
                h ^= half[None, :]
                h = _turned(h, 23)
                h *= two
                h += three
            for j in range(single.shape[1]):
                h ^= single[None, :, j]
                h = _turned(h, 11)
                h *= one
            h ^= h >> np.uint64(33)
            h *= two
            h ^= h >> np.uint64(29)
            h *= three
            h ^= h >> np.uint64(32)
            out[low : low + step, at] = h
    return out.view(np.int64)


def hash_states(seed: int, draws: Iterable[int], pool: str | None = None) -> np.ndarray:
    """What F.xxhash64(seed, pool, draw) is for each draw, or without a pool: a name hashed next gives xxhash64(seed, pool, draw, name)."""
    h = _xxh_int(seed, 42)
    if pool is not None:
        h = int(hashed_names([pool.encode()], np.array([h], np.uint64)).view(np.uint64)[0, 0])
    return np.array([_xxh_int(d, h) for d in draws], np.uint64)


#: Half the width of the range in which a cut is looked for first, in standard deviations of its place.
WINDOW = 5.0

#: A cut of each draw: the hash and the name of the last item of the first half; None if that is empty.
Cuts = dict[str, tuple[np.ndarray, np.ndarray] | None]


def own_cuts(items: DataFrame, sizes: dict[str, tuple[int, int]], draws: int, states: Callable[[str], np.ndarray], window: float | None = None) -> Cuts:
    """The cuts of hash_cuts by the library's own hash, for pools of n items with a first half of first_n (sizes: pool -> (n, first_n)).

    Hashes are even, so the cut lies near first_n / n of their range: tasks count the hashes below a narrow window and return those inside, of all
    draws together, and one number a pool and draw reaches the driver. A window without the cut is looked at again, wider.
    """
    found: Cuts = {pool: None for pool in sizes}
    left = {pool: n for pool, n in sizes.items() if n[1] > 0}
    width = WINDOW if window is None else window
    while left:
        bounds = {}
        for pool, (n, first_n) in left.items():
            q = first_n / n
            apart = width * max(q * (1 - q) / n, 1 / n**2) ** 0.5
            low, high = (min(max(int((q + d) * 2.0**64) - (1 << 63), -(1 << 63)), (1 << 63) - 1) for d in (-apart, apart))
            bounds[pool] = np.int64(low if q - apart > 0 else -(1 << 63)), np.int64(high if q + apart < 1 else (1 << 63) - 1)

        def counted(it: Iterator[pd.DataFrame], bounds=bounds) -> Iterator[pd.DataFrame]:
            below, start = {}, {}
            for pdf in it:
                for pool, own in pdf.groupby("pool", sort=False):
                    if pool not in start:
                        start[pool], below[pool] = states(pool), np.zeros(draws, np.int64)
                    names, (low, high) = [x.encode() for x in own["item"]], bounds[pool]
                    for a in range(0, len(names), 1024):
                        part = names[a : a + 1024]
                        h = hashed_names(part, start[pool])
                        upto, under = h <= high, h < low
                        below[pool] += under.sum(axis=1)
                        draw, at = np.nonzero(upto & ~under)
                        if len(draw):
                            yield pd.DataFrame({"pool": pool, "draw": draw + 1, "h": h[draw, at], "item": pd.Series([part[i].decode() for i in at], dtype=object), "below": 0})
            for pool, n in below.items():
                yield pd.DataFrame({"pool": pool, "draw": np.arange(1, draws + 1), "h": 0, "item": pd.Series([None] * draws, dtype=object), "below": n})

        rows = items.where(F.col("pool").isin(*left)).select("pool", "item").mapInPandas(counted, "pool string, draw int, h long, item string, below long")
        near = F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("h", "item"))))
        first = F.create_map(*[F.lit(x) for pool, (_, k) in left.items() for x in (pool, k)])
        per = rows.groupBy("pool", "draw").agg(near.alias("near"), F.sum("below").alias("below")).withColumn("at", (first[F.col("pool")] - F.col("below")).cast("int"))
        cut = F.when(F.col("at").between(1, F.size("near")), F.get("near", F.col("at") - 1))
        got = per.select("pool", "draw", cut.alias("cut")).toPandas()
        for pool, own in got.groupby("pool"):
            own = own.sort_values("draw")
            if own["cut"].notna().all():
                found[pool] = np.array([c["h"] for c in own["cut"]], np.int64), np.array([c["item"].encode() for c in own["cut"]], object)
                del left[pool]
        width *= 8
    return found


def first_half(names: list[bytes], states: np.ndarray, cut: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """(names x draws): whether each is in the first half of each draw, by own_cuts; states and cut are of the same draws."""
    if cut is None:
        return np.zeros((len(names), len(states)), bool)
    h = hashed_names(names, states)
    first = h < cut[0][:, None]
    for draw, at in zip(*np.nonzero(h == cut[0][:, None])):
        first[draw, at] = names[at] <= cut[1][draw]
    return first.T


def before_cut(hs: Column, ids: Column, draw: Column, h: Column, item: Column) -> Column:
    """Whether an item of hash h is in the first half of a draw, by its pool's row of hash_cuts."""
    cut = F.get(hs, draw - 1)
    return F.coalesce((h < cut) | ((h == cut) & (item <= F.get(ids, draw - 1))), F.lit(False))


def positions(units: DataFrame, stratum: str, unit: str) -> DataFrame:
    """(stratum, unit, pos): units of a stratum in their order from 0."""
    order = Window.partitionBy(stratum).orderBy(unit)
    return units.select(F.col(stratum).alias("stratum"), F.col(unit).alias("unit"), (F.row_number().over(order) - 1).cast("long").alias("pos"))


def weighted_means(counts: DataFrame, exposure: DataFrame, weights: DataFrame) -> DataFrame:
    """(draw, feature, mu): ratio of weighted sums of counts (feature, unit, y) and exposures (unit, expo) for weights (draw, unit, w)."""
    down = weights.join(exposure, "unit").groupBy("draw").agg(F.sum(F.col("w") * F.col("expo")).alias("se"))
    up = counts.join(weights, "unit").groupBy("draw", "feature").agg(F.sum(F.col("w") * F.col("y")).alias("sy"))
    return up.join(F.broadcast(down), "draw").select("draw", "feature", (F.col("sy") / F.col("se")).alias("mu"))


def draw_summary(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi, se, nfin, infinite): type-1 2.5 and 97.5 % points of the draws that are there; null under three draws.

    se: the interval's width over 3.92; where draws are infinite the standard deviation isn't defined and this is.
    """
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v)
    g = draws.where(finite).groupBy(*keys)
    lo, hi = F.expr(f"percentile_disc(0.025) WITHIN GROUP (ORDER BY {value})"), F.expr(f"percentile_disc(0.975) WITHIN GROUP (ORDER BY {value})")
    s = g.agg(F.count("*").alias("nfin"), lo.alias("lo"), hi.alias("hi"), F.avg((F.abs(v) == float("inf")).cast("int")).alias("infinite"))
    some = F.col("nfin") >= 3
    return s.select(*keys, F.when(some, F.col("lo")).alias("lo"), F.when(some, F.col("hi")).alias("hi"), F.when(some, (F.col("hi") - F.col("lo")) / 3.92).alias("se"), "nfin", "infinite")


def relabel_halves(units: DataFrame, draws: int, seed: int, first: int) -> DataFrame:
    """(draw, unit, half): in each draw the `first` units of a hashed order are half 1, the others 2."""
    each = units.select("unit", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "unit"), "unit")
    return each.select("draw", "unit", F.when(F.row_number().over(order) <= first, 1).otherwise(2).alias("half"))


def swap_alleles(units: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, unit, swap): whether a unit's two alleles trade places in a draw, by one bit of a hash."""
    each = units.select("unit", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return each.select("draw", "unit", (F.pmod(F.xxhash64(F.lit(seed), "draw", "unit"), F.lit(2)) == 1).alias("swap"))


def null_log2_ratio(counts: DataFrame, exposure: DataFrame, labels: DataFrame) -> DataFrame:
    """(draw, feature, value): log2 ratio of the halves' mean rates; only half 1 is aggregated, half 2 is the rest.

    counts (feature, unit, y) of the pooled units, exposure (unit, expo), labels (draw, unit, half).
    """
    one = labels.where("half = 1").select("draw", "unit")
    total = counts.groupBy("feature").agg(F.sum("y").alias("ty"))
    whole = exposure.agg(F.sum("expo").alias("te"))
    e1 = one.join(exposure, "unit").groupBy("draw").agg(F.sum("expo").alias("e1"))
    y1 = counts.join(one, "unit").groupBy("draw", "feature").agg(F.sum("y").alias("y1"))
    grid = total.join(F.broadcast(e1)).join(F.broadcast(whole)).join(y1, ["draw", "feature"], "left").na.fill(0, ["y1"])
    a, b = F.col("y1") / F.col("e1"), (F.col("ty") - F.col("y1")) / (F.col("te") - F.col("e1"))
    value = F.when((a == 0) & (b == 0), None).when(b == 0, float("inf")).when(a == 0, float("-inf")).otherwise(F.log2(a / b))
    return grid.select("draw", "feature", value.alias("value"))


def permutation_p(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obs, p, n): add-one two-sided p of obs against the null's values; infinite values count, missing ones don't."""
    v = F.when(~F.isnan("value"), F.col("value"))
    rows = observed.join(null.select(*keys, v.alias("_v")), keys)
    return rows.groupBy(*keys, "obs").agg(((1 + F.count_if(F.abs("_v") >= F.abs("obs"))) / (1 + F.count("_v"))).alias("p"), F.count("_v").alias("n"))


def smallest_detectable(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """(keys, ratio): where power first reaches the target along ratio, by linear interpolation on log2(ratio); null if never."""
    order = Window.partitionBy(*keys).orderBy("ratio")
    steps = curve.withColumn("_x", F.lag("ratio").over(order)).withColumn("_y", F.lag("power").over(order))
    x0, x1 = F.log2("_x"), F.log2("ratio")
    at = F.when(F.col("_x").isNull() | (F.col("_y") >= target), F.col("ratio")).otherwise(F.pow(F.lit(2.0), x0 + (target - F.col("_y")) * (x1 - x0) / (F.col("power") - F.col("_y"))))
    return steps.groupBy(*keys).agg(F.min_by(F.when(F.col("power") >= target, at), F.when(F.col("power") >= target, F.col("ratio"))).alias("ratio"))


def curve_crossing(curves: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, at): the first x at which a - b changes sign, by linear interpolation; null if never."""
    order = Window.partitionBy(*keys).orderBy("x")
    d = curves.withColumn("_d", F.col(a) - F.col(b))
    d = d.withColumn("_e", F.lag("_d").over(order)).withColumn("_w", F.lag("x").over(order))
    crossed = F.col("_e").isNotNull() & (F.signum("_e") != F.signum("_d"))
    at = F.col("_w") + F.col("_e") / (F.col("_e") - F.col("_d")) * (F.col("x") - F.col("_w"))
    return d.groupBy(*keys).agg(F.min_by(F.when(crossed, at), F.when(crossed, F.col("x"))).alias("at"))


def seed_agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, rho, median_ratio, iqr_ratio) of two replicates of a value."""
    from dispersa.functions.stats import spearman

    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).withColumn("_g", F.lit(1))
    rho = spearman(both, "_a", "_b", ["_g"])
    ratio = F.try_divide(F.col("_a"), F.col("_b"))
    q = both.groupBy("_g").agg(F.percentile(ratio, 0.5).alias("median_ratio"), (F.percentile(ratio, 0.75) - F.percentile(ratio, 0.25)).alias("iqr_ratio"))
    return rho.join(q, "_g").select("n", "rho", "median_ratio", "iqr_ratio")


def disattenuated(df: DataFrame, x: str, y: str, se_x: str, se_y: str) -> DataFrame:
    """(n, var_x, var_y, cov, raw, corrected): correlation with the mean squared standard errors taken from the variances."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(se_x).isNotNull() & F.col(se_y).isNotNull())
    s = ok.agg(F.count("*").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cov"), F.avg(F.col(se_x) * F.col(se_x)).alias("ex"), F.avg(F.col(se_y) * F.col(se_y)).alias("ey"))
    tx, ty = F.col("vx") - F.col("ex"), F.col("vy") - F.col("ey")
    return s.select("n", tx.alias("var_x"), ty.alias("var_y"), "cov", F.try_divide(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy"))).alias("raw"), F.when((tx > 0) & (ty > 0), F.col("cov") / F.sqrt(tx * ty)).alias("corrected"))
