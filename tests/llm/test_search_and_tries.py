"""Ranked search, prefix tries and the multi-index against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispersa.llm.lexical import top_documents
from dispersa.llm.multiindex import linked_vectors
from dispersa.llm.trie import DoubleArray, pack, rebuilt, trie_nodes, turn_sequences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=20):
    docs = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in docs:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("first_read", [1, 4000])
def test_search_equals_scores_of_all_documents(spark, awkward, first_read):
    items = [(1, awkward[5][1]), (2, awkward[20][1]), (3, None), (4, "..."), (5, "Karan TER karan one"), (5, "Karan TER karan one"), (None, "suNmel ÄÖ"), (6, "nowhere")]
    docs = [*awkward, *[(1000 + i, "karan ter one two", "en", "s", 3) for i in range(60)], *[(2000 + i, f"karan {w}", "", "", 0) for i, w in enumerate(["ter", "zz", "ter"] * 9)]]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("term", F.lit(1)).withColumn("tid", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(0)).withColumn("doc_id", F.lit(9))
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], items)
    assert found(top_documents(docs, asked, first_read=first_read)) == want


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "karan")], "item_id long, text string")
    assert top_documents(empty, items).collect() == [] and top_documents(docs, items.limit(0)).collect() == []
    assert top_documents(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_reads_less_than_all_lists(spark, monkeypatch):
    from dispersa.llm import lexical

    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(20, 60)))) for i in range(1500)]
    rows += [(5000 + i, " ".join(f"w{j}" for j in range(200, 230))) for i in range(25)]
    read = []
    whole = lexical._bounds
    monkeypatch.setattr(lexical, "_bounds", lambda p, cuts, left: read.append((whole(p, cuts, left).count(), p.count())) or whole(p, cuts, left))
    items = [(1, " ".join(f"w{j}" for j in [*range(200, 230), 0, 1, 2]))]
    got = found(top_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), first_read=500))
    assert got == ranked(rows, items)
    assert all(n < 0.3 * all_of_them for n, all_of_them in read)


def nodes(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}
    new = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + s[h:] for c, s in own.items()}
    members = defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items()), key=str)


def built(spark, rows, shard_turns):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("keys", F.lit(1)).withColumn("n", F.lit("n"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, trie_nodes(rebuilt(turn_sequences(table)), shard_turns).select(*columns).collect()), key=str)


@pytest.mark.parametrize("shard_turns", [40, 50_000])
def test_trie_nodes(spark, shard_turns):
    """A third of the conversations alike, a hot first turn, nulls, repeated rows, a deep conversation and its near copy."""
    rng = random.Random(3)
    rows = [(c, t, "user", f"same é {t}") for c in range(10_000, 10_100) for t in range(3)]
    rows += [(c, t, rng.choice(["user", None]), "hot" if t == 0 else f"t{rng.randint(0, 3)}") for c in range(100) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"deep {t}" if t < 250 else f"end {c}") for c in (7001, 7013) for t in range(251)]
    rows += [(20_000, None, None, None), (20_000, 2, "a", ""), (20_000, 2, "a", ""), (20_000, 1, "b", "x" * 9000), (None, 1, "a", "b"), (20_003, 5, "ab", "c"), (20_004, 5, "a", "bc")]
    rng.shuffle(rows)
    assert built(spark, rows, shard_turns) == nodes(rows)


def test_trie_of_no_conversation(spark):
    assert built(spark, [], 10) == [] and built(spark, [(None, 1, "a", "b")], 10) == []


def test_double_array_finds_what_was_put_in_and_nothing_else():
    rng = np.random.default_rng(4)
    sequences = sorted({tuple(rng.integers(0, 30, rng.integers(0, 6)).tolist()) for _ in range(2000)})
    sizes = np.array([len(s) for s in sequences])
    codes = np.array([x for s in sequences for x in s], np.int64)
    trie, dense = pack(codes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    place = {(): 0}
    for p in sorted(prefixes, key=len):
        for code in range(30):
            at = int(trie.child(np.array([place[p]]), dense[np.array([code])])[0])
            assert (at >= 0) == (p + (code,) in prefixes)
            if at >= 0:
                place[p + (code,)] = at
    assert len(set(place.values())) == len(prefixes) and trie.end < 1.5 * len(prefixes)
    assert isinstance(trie, DoubleArray)


def linked(rows, least=0.95):
    usable = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, part = [0] * len(rows), list(range(len(rows)))
    for x, (i, v) in enumerate(usable):
        for j, w in usable[x + 1 :]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    ids = [r[0] for r in rows]
    names = {p: min((ids[i] for i in range(len(rows)) if part[i] == p and ids[i] is not None), default=None) for p in part}
    return sorted([(ids[i], links[i], names[part[i]], ids[i] is not None and ids[i] == names[part[i]]) for i in range(len(rows))], key=str)


def turned(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= w @ v * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


@pytest.mark.parametrize(("kind", "block"), [("float", 2048), ("double", 16)])
def test_vectors_with_odd_cases(spark, kind, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (turned(rng, base[0], 0.99) * 3).tolist()) for i in range(40)]
    rows += [(200 + i, base[1].tolist()) for i in range(30)] + [(200, base[1].tolist()), (None, base[1].tolist()), (None, None)]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [1.0, None] * 6), (304, [float("nan")] * 12), (305, [float("inf")] + [0.0] * 11), (306, [1.0]), (307, [2.0]), (308, [-1.0]), (309, [1e30, 1e-30, 0.0]), (310, [1e30, 0.0, 0.0])]
    rows = [(i, v if v is None else [x if x is None or kind == "double" else float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("row", F.lit("a")).withColumn("links", F.lit(1)).withColumn("cell", F.lit(2))
    got = sorted(map(tuple, linked_vectors(table, block=block, cell=4).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == linked(rows)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert linked_vectors(none).collect() == []
    assert [tuple(r) for r in linked_vectors(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()] == [(4, 0, 4, True)]


def test_recall_of_the_hardest_pairs(spark):
    """Pairs just above the least similarity, among vectors without any structure."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5000 + i, turned(rng, base[i], 0.9505).tolist()) for i in range(1000)]
    got = {r.vec_id: r for r in linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=50).collect()}
    assert sum(got[5000 + i].component_id == i for i in range(1000)) >= 980
    assert all(got[i].n_links == 0 for i in range(1000, 3000))
