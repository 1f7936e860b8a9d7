"""Over-representation and rank enrichment of feature sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispersa.functions.stats import benjamini_hochberg
from dispersa.operators.classes import log_factorials
from dispersa.sources.results import checkpointed


def term_closure(term2feature: DataFrame, parents: DataFrame) -> DataFrame:
    """(term, feature) with the features of all descendants; parents (term, parent) without cycles."""
    pairs = term2feature.select("term", "feature").distinct()
    up = pairs
    while not up.isEmpty():
        up = checkpointed(up.join(parents, "term").select(F.col("parent").alias("term"), "feature").join(pairs, ["term", "feature"], "left_anti").distinct())
        pairs = checkpointed(pairs.union(up))
    return pairs


def over_representation(sets: DataFrame, term2feature: DataFrame, universe: DataFrame, smallest: int = 10, largest: int = 500) -> DataFrame:
    """(set_name, term, overlap, term_size, set_size, p, q): upper hypergeometric tails with BH within a set.

    Terms count features of the universe and must have smallest..largest of them; sets with under two features are left out.
    """
    inside = term2feature.join(universe.select("feature").distinct(), "feature", "left_semi").distinct()
    size = inside.groupBy("term").agg(F.count("*").alias("m")).where(F.col("m").between(smallest, largest))
    chosen = sets.join(universe.select("feature").distinct(), "feature", "left_semi").distinct()
    k = chosen.groupBy("set_name").agg(F.count("*").alias("k")).where("k >= 2")
    total = universe.select("feature").distinct().agg(F.count("*").alias("n"))
    hits = chosen.join(inside, "feature").groupBy("set_name", "term").agg(F.count("*").alias("x"))
    rows = hits.join(size, "term").join(k, "set_name").join(F.broadcast(total))
    each = rows.withColumn("j", F.explode(F.sequence("x", F.least("k", "m"))))
    n = total.first()[0]
    lf = log_factorials(sets.sparkSession, n)
    for name, at in (("a", "m"), ("b", "n - m"), ("c", "k"), ("d", "n - k"), ("e", "n"), ("f", "j"), ("g", "m - j"), ("h", "k - j"), ("i", "n - m - k + j")):
        each = each.withColumn("_k", F.expr(at)).where("_k >= 0").join(lf.select(F.col("n").alias("_k"), F.col("v").alias(f"l_{name}")), "_k").drop("_k")
    pmf = F.exp(F.expr("l_a + l_b + l_c + l_d - l_e - l_f - l_g - l_h - l_i"))
    p = each.groupBy("set_name", "term", "x", "m", "k").agg(F.least(F.lit(1.0), F.sum(pmf)).alias("p"))
    out = p.select("set_name", "term", F.col("x").alias("overlap"), F.col("m").alias("term_size"), F.col("k").alias("set_size"), "p")
    return benjamini_hochberg(out, "p", ["set_name"])


def running_sum_score(ranks: DataFrame, term2feature: DataFrame) -> DataFrame:
    """(list, term, es): extreme of the weighted running sum along each list (list, feature, score), the highest score first.

    Only hits are walked: before hit number h at rank r the sum has lost (r - h) / (n - hits), so extremes stand right at or
    right before a hit.
    """
    order = Window.partitionBy("list").orderBy(F.desc("score"), "feature")
    n = ranks.groupBy("list").agg(F.count("*").alias("n"))
    placed = ranks.withColumn("r", F.row_number().over(order)).join(n, "list")
    hits = placed.join(term2feature.select("term", "feature").distinct(), "feature")
    own = Window.partitionBy("list", "term").orderBy("r")
    whole = Window.partitionBy("list", "term")
    w = F.abs("score")
    walk = hits.withColumn("h", F.row_number().over(own)).withColumn("up", F.sum(w).over(own) / F.sum(w).over(whole)).withColumn("m", F.count("*").over(whole)).withColumn("w", w / F.sum(w).over(whole))
    down = F.try_divide(F.col("r") - F.col("h"), F.col("n") - F.col("m"))
    after, before = F.col("up") - F.coalesce(down, F.lit(0.0)), F.col("up") - F.col("w") - F.coalesce(down, F.lit(0.0))
    ends = walk.groupBy("list", "term").agg(F.max(after).alias("hi"), F.min(before).alias("lo"))
    return ends.select("list", "term", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


#: Random sets that a task scores at a time, and their elements.
SETS_TOGETHER, ELEMENTS_TOGETHER = 100, 2_000_000
#: Tasks among which a list's random sets are dealt.
COPIES = 16


def null_scores(weights: np.ndarray, size: int, seed: int, first: int, many: int) -> np.ndarray:
    """Scores of random sets of a size, numbers first .. first + many - 1, on a list of weights from the highest score down."""
    n, out = len(weights), np.empty(many)
    step = max(1, ELEMENTS_TOGETHER // n)
    for low in range(0, many, step):
        draws = range(first + low, first + min(many, low + step))
        r = np.sort(np.stack([np.random.Generator(np.random.Philox(key=[seed, d])).choice(n, size, replace=False, shuffle=False) for d in draws]), axis=1)
        w = weights[r]
        total = w.sum(1, keepdims=True)
        w = np.divide(w, total, out=np.full(w.shape, 0.0), where=total > 0)
        down = (r - np.arange(size)) / max(n - size, 1)
        up = np.cumsum(w, axis=1)
        high, least = (up - down).max(1), (up - w - down).min(1)
        out[low : low + len(r)] = np.where(high >= -least, high, least)
    return out


def normalised_scores(ranks: DataFrame, term2feature: DataFrame, draws: int = 100_000, seed: int = 1) -> DataFrame:
    """(list, term, size, es, nes, p, q): running-sum scores over the mean of random sets' scores of the same sign, with add-one p.

    A null depends on the list and the set's size alone, so all terms of one size share its random sets. A task scores a block of them and
    returns counts and sums for each term, never walks. The random sets follow from (seed, number, list, size), whatever the partitioning.
    nes and p are null where no random set has the sign. q: Benjamini-Hochberg within a list. A task holds a list's weights.
    """
    sizes = ranks.select("list", "feature").join(term2feature.select("term", "feature").distinct(), "feature").groupBy("list", "term").agg(F.count("*").alias("size"))
    seen = running_sum_score(ranks, term2feature).where("es IS NOT NULL").join(sizes, ["list", "term"])
    terms = seen.groupBy("list", "size").agg(F.collect_list(F.struct("term", "es")).alias("t"))
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "feature", F.abs("score").alias("w")))), lambda x: x["w"])
    lists = ranks.groupBy("list").agg(order.alias("w"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // SETS_TOGETHER))).alias("block")
    # each list goes to COPIES tasks; the numbers of partitions are given, as Spark would put these few rows into one task
    several = max(1, ranks.sparkSession.sparkContext.defaultParallelism * 4)
    copy = F.pmod(F.xxhash64("size", "block"), F.lit(COPIES)).cast("int")
    work = terms.select("list", "size", "t", blocks).withColumn("_c", copy).repartition(several, "list", "_c")
    work = work.hint("shuffle_hash").join(lists.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).repartition(several, "list", "_c"), ["list", "_c"])
    kind = dict(seen.dtypes)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for name, size, t, block, w in pdf[["list", "size", "t", "block", "w"]].itertuples(index=False):
                first = int(block) * SETS_TOGETHER
                own = zlib.crc32(f"{name}\0{size}".encode()) << 20 | seed
                null = null_scores(np.asarray(w, float), int(size), own, first, min(SETS_TOGETHER, draws - first))
                for x in t:
                    same = null[null >= 0] if x["es"] >= 0 else null[null < 0]
                    rows.append((name, x["term"], len(same), float(np.abs(same).sum()), int((np.abs(same) >= abs(x["es"])).sum())))
            yield pd.DataFrame(rows, columns=["list", "term", "n", "s", "hits"])

    parts = work.mapInPandas(run, f"list {kind['list']}, term {kind['term']}, n long, s double, hits long")
    null = parts.groupBy("list", "term").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("hits").alias("hits"))
    out = seen.join(null, ["list", "term"]).withColumn("nes", F.when(F.col("s") > 0, F.col("es") * F.col("n") / F.col("s"))).withColumn("p", F.when(F.col("n") > 0, (1 + F.col("hits")) / (1 + F.col("n"))))
    return benjamini_hochberg(out.select("list", "term", "size", "es", "nes", "p"), "p", ["list"])


def significant_counts(terms: DataFrame, sig: float = 0.05) -> DataFrame:
    """(set_name, n): significant terms of each set, 0 for sets without any."""
    return terms.groupBy("set_name").agg(F.count_if(F.col("q") < sig).alias("n"))
