"""Sharding, packing, decontamination, fingerprints: brute force, round trips and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from dispersa.llm import decontamination, fingerprints, packing, sharding
from dispersa.llm.queries import tokenizer_path


def brute_shard(key, weights):
    best = None
    for j, w in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        bits = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed) >> 11
        cost = -math.log((bits + 0.5) / 2**53) / w
        best = min(best or (cost, j), (cost, j))
    return best[1]


def test_shards(docs, awkward):
    got = sharding.op3_shards(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_shard(d, [1] * 8), brute_shard(d, [1] * 9)) for d, t, *_ in awkward)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.shard == r.grown_shard or r.grown_shard == 8 for r in got)


def test_weights_move_few_rows(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = sharding.assign_shards(ids, ["doc_id"], [1.0, 1.0, 2.0], "a")
    b = sharding.assign_shards(a, ["doc_id"], [1.0, 1.0, 3.0], "b")
    rows = b.collect()
    share = Counter(r.a for r in rows)
    assert abs(share[2] / 4000 - 0.5) < 0.05
    assert all(r.a == r.b or r.b == 2 for r in rows)


def test_shards_of_an_empty_table(empty):
    assert sharding.op3_shards(empty).count() == 0


def test_packing_round_trip(docs, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    limit = 256
    rows = packing.pack_documents(docs, tokenizer_path(), limit).collect()
    want = Counter()
    for d, t, *_ in awkward:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for low in range(0, len(ids), limit):
            part = ids[low : low + limit]
            want[d, low, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    packs = defaultdict(list)
    for r in rows:
        packs[r.sequence_id].append((r.offset, r.length))
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= limit


@pytest.mark.parametrize(("words", "piece"), [(600_000, 1 << 19), (40, 1 << 19), (40, 50)])
def test_encoder_agrees_with_the_tokenizer(monkeypatch, words, piece):
    monkeypatch.setattr(packing, "PIECE", piece)
    encoder = packing.WordEncoder(tokenizer_path(), words, 5 * words)
    rng = random.Random(words + piece)
    signs = list("abXYZ.,;:!?'12 \n\t\u00a0\u3000é\u030c\u0301\u0327İIıßǰJĶ\u200bñÑ中国😀-_ΣςΑ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["CUMHURİYETİ.", "İŞLERİ, x", "don't", "I'M it's 'tis", "J\u030c.", "x" * 3000, "ab " * 2000, "", " \n"]
    for text, ids in zip(texts, encoder.many(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [0, 10**6])
def test_pieces_of_one_length_are_placed_gaplessly(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", most)
    lengths = [10] * 700 + [100] * 90 + [33] * 210 + [7, 90, 64]
    pieces = spark.createDataFrame([(i, 0, n, 1) for i, n in enumerate(lengths)], "doc_id long, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(pieces, 100).collect()
    assert Counter(r.length for r in rows) == Counter(lengths) and len({r.doc_id for r in rows}) == len(rows)
    packs = defaultdict(list)
    for r in rows:
        packs[r.sequence_id].append((r.offset, r.length))
    for p in packs.values():
        ends = [0, *(o + n for o, n in sorted(p))]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= 100


@pytest.mark.parametrize("seed", range(4))
def test_histogram_packing(seed):
    rng = np.random.Generator(np.random.Philox(seed))
    lengths = Counter(int(x) for x in np.clip(rng.lognormal(6.2, 1.1, 50_000), 1, 4096))
    packs = packing.pack_histogram(lengths, 4096)
    placed = Counter()
    for pattern, count in packs:
        assert sum(pattern) <= 4096 and count > 0
        for size in pattern:
            placed[size] += count
    assert placed == lengths
    assert sum(c for _, c in packs) * 4096 <= 1.02 * sum(k * v for k, v in lengths.items())


def test_packing_of_an_empty_table(empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


ITEM = "Anna has 5 apples and buys 3 kg of rice in the old market. Then Anna gives Bob two apples and walks 4 miles back to the house."


def test_reparameterised_items_are_caught(spark):
    other = ITEM.replace("Anna", "Maria").replace("Bob", "Tom").replace("5", "17").replace("3 kg", "12 kg").replace("two", "nine").replace("miles", "km")
    mixed = ITEM.replace("Anna has", "Maria has").replace("Then Anna", "Then Clara")
    docs = spark.createDataFrame(
        [(1, "Some words before. " + ITEM + " And after."), (2, "x y z\n" + other), (3, ITEM[:40]), (4, None), (5, ""), (6, ITEM.replace("\n", " ").replace(" ", "  ")), (7, mixed), (2, "x y z\n" + other), (None, ITEM)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 10), (None, 10)}
    assert got[1, 10].verbatim and not got[2, 10].verbatim and got[2, 10].slots > 3


def test_inconsistent_slots_are_left_alone(spark):
    item = "The price of 5 pens is 5 coins so 5 more pens cost 5 more coins and 5 boys pay 5 coins for 5 pens at noon."
    odd = item
    for n in range(31, 38):
        odd = odd.replace(" 5 ", f" {n} ", 1)
    same = item.replace(" 5 ", " 8 ")
    docs = spark.createDataFrame([(1, odd), (2, same)], "doc_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {2}


def test_each_occurrence_is_judged_by_itself(spark):
    numbers = lambda a, b, c: ITEM.replace("5", a).replace("3 kg", f"{b} kg").replace("two", c).replace("4 miles", "6 km")
    again = [numbers("17", "12", "nine"), numbers("8", "31", "six"), numbers("44", "70", "ten")]
    words = ITEM.split()
    half, rest = " ".join(words[:13]), " ".join(words[13:])
    docs = spark.createDataFrame(
        [(1, ITEM + " " + again[0]), (2, " And so on. ".join(again)), (3, "w " * 300 + again[0] + " x" * 40 + ". " + ITEM), (4, half + " y" * 400 + " " + rest),
         (5, half + " very very much " + rest + "\n" + again[1]), (None, again[0]), (None, again[1]), (None, "nothing here")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in decontamination.contaminated(docs, spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 5, None}
    assert got[1].verbatim and got[1].first_pos == 0 and got[1].coverage == 1
    assert got[3].verbatim and got[3].first_pos == 300 + len(words) + 40
    assert not got[2].verbatim and not got[None].verbatim


def test_names_at_sentence_begins_and_folded_case(spark):
    short = "Anna has 5 apples. Anna buys 3 kg of rice. Bob sells 4 pears."
    other = "Maria has 17 apples. Maria buys 12 kg of rice. Tom sells 9 pears."
    inside = "At noon the boys met Anna and Bob near the gate where Carl sold 7 old books to Dora for 3 euros."
    docs = spark.createDataFrame(
        [(1, "So it is. " + other), (3, "we read that " + inside.lower()), (4, inside.replace(" and Bob", "\nand\nBob").replace("to Dora", "to\nDora")), (5, "He said: what is 6 times 7? Well."), (6, "what is 6 times 8"), (7, "7 8 9 10 11 12 13 etc"), (8, "7 8 9 10 11 12 14")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(10, short), (11, inside), (12, "Is 6 times 7?"), (13, "7 8 9 10 11 12 13"), (14, "?"), (15, "times 9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 10): False, (3, 11): True, (4, 11): True, (5, 12): True, (7, 13): True}


def test_white_space_of_any_kind_and_rows_without_ids(spark):
    spaced = [ITEM.replace(" ", x) for x in ("\t", "\u00a0", "\u3000", "\r\n", "  \n ")]
    docs = spark.createDataFrame([*enumerate(spaced), (None, "x " + ITEM), (None, "nothing of it"), (None, None), (9, "own words"), (9, ITEM)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS th", "'a' AS row", "doc_id AS `a.b`")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench).collect()} == {0, 1, 2, 3, 4, 9, None}
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == [(-1, ""), (-1, "nothing of it"), (9, "own words")]
    assert decontamination.keep_clean(docs.limit(0), bench).count() == 0


def test_decontamination_without_a_broadcast_or_rows(spark, monkeypatch, empty):
    docs = spark.createDataFrame([(1, "so " + ITEM), (2, "nothing of it " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 3)
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [1]
    monkeypatch.undo()
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_edited_fingerprints(spark, docs, awkward):
    rows = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(((d, t or "") for d, t, *_ in awkward), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        e = (t[: len(t) - k] + u[:k]).encode()
        a, c, n = fingerprints._sketch_texts([t.encode(), e, u.encode()])
        want[d, len(t), hashlib.sha256(e).hexdigest(), a.tobytes().hex(), c.tobytes().hex(), float((a == c).mean()), float((a == n).mean())] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)
    assert got == want


def test_fingerprints_don_t_depend_on_the_offset():
    rng = np.random.Generator(np.random.Philox(3))
    body = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    a, b, c = fingerprints._sketch_texts([body, b"prefix " + body + b" suffix", bytes(rng.integers(97, 123, 4000).astype(np.uint8))])
    assert (a == b).mean() > 0.9 and (a == c).mean() < 0.2


def test_single_and_no_document(spark, empty):
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert fingerprints.edited_fingerprints(empty).count() == 0
