"""Halves by hash cuts, and draws of large strata, against plain order and counts."""

from pyspark.sql import functions as F

from dispersa.operators import nulls, resampling


def test_cuts_divide_pools_as_an_order_by_hash_does(spark):
    items = spark.createDataFrame([(p, f"u{i:03d}") for p, n in (("a", 150), ("b", 40), ("none", 5)) for i in range(n)], "pool string, item string")
    sizes = {"a": 61, "b": 40, "none": 0}
    few = lambda pool, draw, item: F.pmod(F.xxhash64(F.lit(3), pool, draw, item), F.lit(23))  # noqa: E731  many equal hashes, told apart by name
    for hashed, shift in ((lambda pool, draw, item: F.xxhash64(F.lit(3), pool, draw, item), 52), (few, 2)):
        cuts = resampling.hash_cuts(items, spark.createDataFrame(list(sizes.items()), "pool string, first_n long"), 7, hashed, shift)
        assert cuts.count() == 2
        each = items.join(cuts, "pool", "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("draw")).withColumn("h", hashed(F.col("pool"), F.col("draw"), F.col("item")))
        rows = each.withColumn("f", resampling.before_cut(F.col("hs"), F.col("ids"), F.col("draw"), F.col("h"), F.col("item"))).collect()
        for pool, n in sizes.items():
            for draw in range(1, 8):
                own = sorted((r.h, r.item, r.f) for r in rows if r.pool == pool and r.draw == draw)
                assert [f for *_, f in own] == [i < n for i in range(len(own))]


def test_runs_of_slots_give_the_same_draws(spark, monkeypatch):
    strata = spark.createDataFrame([("a", 25), ("b", 7), ("none", 0)], "stratum string, n long")
    want = {}
    slots = [(s, n, d, i) for s, n in (("a", 25), ("b", 7)) for d in (1, 2, 3) for i in range(n)]
    for r in spark.createDataFrame(slots, "stratum string, n long, draw int, slot long").select("draw", "stratum", resampling.hashed_pick(4, F.col("draw"), F.col("slot"), F.col("n")).alias("pos")).collect():
        want[tuple(r)] = want.get(tuple(r), 0) + 1
    monkeypatch.setattr(resampling, "SLOTS", 6)
    assert {(r.draw, r.stratum, r.pos): r.w for r in resampling.bootstrap_weights(strata, 3, 4).collect()} == want


def test_labelled_items_have_the_stored_labels(spark, monkeypatch):
    rows = [(p, f"{s}:u{i:02d}", f"u{i:02d}", s, 1.0) for p in ("total", "cis") for s, n in ((0, 12), (1, 12 if p == "cis" else 9)) for i in range(n)]
    items = spark.createDataFrame(rows, "pool string, item string, unit string, side int, expo double")
    want = {(r.pool, r.item, r.draw): r.first for r in nulls.item_labels(items, 6, 3).collect()}
    monkeypatch.setattr(nulls, "MOST_DRAWS", 4)
    got = {(r.pool, r.item, r.low + i): x for r in nulls.labelled_items(items, 6, 3).collect() for i, x in enumerate(r.firsts)}
    assert got == want


def test_hashes_in_tasks_are_those_of_spark(spark):
    names = ["", "a", "abc", "abcd", "0:123456", "1:1234567", "true:1234567", "x" * 31, "y" * 32, "ü" * 20, "z" * 77]
    rows = spark.createDataFrame([(x,) for x in names], "item string").select("item", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("d"))
    got = rows.select("item", "d", F.xxhash64(F.lit(3), F.lit("pool"), "d", "item").alias("p"), F.xxhash64(F.lit(-4), "d", "item").alias("q")).collect()
    own = {pool: resampling.hashed_names([x.encode() for x in names], resampling.hash_states(seed, range(1, 10), pool)) for pool, seed in (("pool", 3), (None, -4))}
    assert all(own["pool"][r.d - 1, names.index(r.item)] == r.p and own[None][r.d - 1, names.index(r.item)] == r.q for r in got)


def test_own_cuts_are_those_of_an_order(spark):
    items = spark.createDataFrame([(p, f"{i % 2}:u{i:03d}") for p, n in (("a", 150), ("b", 40), ("none", 5)) for i in range(n)], "pool string, item string")
    sizes = {"a": (150, 61), "b": (40, 40), "none": (5, 0)}
    states = lambda pool: resampling.hash_states(3, range(1, 8), pool)
    hashed = lambda pool, draw, item: F.xxhash64(F.lit(3), pool, draw, item)
    want = {r.pool: list(zip(r.hs, r.ids)) for r in resampling.hash_cuts(items, spark.createDataFrame([(p, n[1]) for p, n in sizes.items()], "pool string, first_n long"), 7, hashed).collect()}
    for window in (None, 0.001):  # the second one misses at first
        got = resampling.own_cuts(items, sizes, 7, states, window)
        assert got["none"] is None and {p: list(zip(c[0].tolist(), [x.decode() for x in c[1]])) for p, c in got.items() if c} == want
    names = [f"{i % 2}:u{i:03d}".encode() for i in range(150)]
    assert (resampling.first_half(names, states("a"), got["a"]).sum(axis=0) == 61).all() and not resampling.first_half(names, states("none"), None).any()
