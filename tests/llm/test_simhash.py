"""SimHash fingerprints and components, against brute force."""

import random
from collections import Counter

import pytest
import xxhash

from dispersa.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, most):
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_documents(awkward, docs):
    fps = {i: brute_fingerprint(r[1]) for i, r in enumerate(awkward)}
    comp = brute_components(set(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        d = awkward[i][0]
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    want = Counter((awkward[i][0], f"{f:016x}", least.get(comp[f])) for i, f in fps.items())
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("bucket", [1, 4, simhash.BUCKET])
@pytest.mark.parametrize("most", [1, 2])
def test_links_connect_all_close_pairs(spark, bucket, most):
    rng = random.Random(bucket)
    nodes = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        nodes.add(x)
        for _ in range(15):
            x ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            nodes.add(x)
    df = spark.createDataFrame([(simhash._signed(x),) for x in nodes], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.close_pairs(df, most, bucket).collect()]
    assert all((a ^ b).bit_count() <= most and a != b for a, b in links)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = brute_components(nodes, most)
    assert len({find(n) for n in nodes}) == len(set(want.values()))
    assert all((find(a) == find(b)) == (want[a] == want[b]) for a in nodes for b in list(nodes)[:20])


def test_one_of_each_group_stays(docs, awkward):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    comp = brute_components({brute_fingerprint(r[1]) for r in awkward}, 2)
    assert kept.count() == len(set(comp.values()))


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_each(empty).count() == 0


def edited(rng, words, share):
    """A copy with words changed, whose 5-word Jaccard index with the words is just at or above `share`."""
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    copy = list(words)
    for i in rng.sample(range(len(words)), len(words)):
        more = [*copy[:i], f"new{i}", *copy[i + 1 :]]
        if len(grams(words) & grams(more)) < share * len(grams(words) | grams(more)):
            break
        copy = more
    return copy


def test_edited_copies_lose_all_but_one(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows, want = [], set()
    for n in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        want.add(len(rows))
        rows += [(len(rows) + i, t) for i, t in enumerate([" ".join(words), *(" ".join(edited(rng, words, s)) for s in (0.8, 0.87, 0.95)), " ".join(words).upper()])]
        # half of the text is shared: under 0.8
        want.add(len(rows))
        rows.append((len(rows), " ".join(words[: len(words) // 2] + [f"x{rng.randrange(3000)}" for _ in words[::2]])))
    crowd = [f"c{i}" for i in range(120)]
    want.add(1000)
    rows += [(1000 + i, " ".join([*crowd[:i], "edit", *crowd[i + 1 :]])) for i in range(60)]
    want |= {2000, 2001}
    rows += [(2000, "one two three"), (2001, "one two four"), (2002, " One two\nthree"), (2001, "one two four")]
    docs = spark.createDataFrame([*rows, *((None, f"no id but text {i} of its own") for i in range(5))], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(want)
    assert kept.count(None) == 5


def test_similar_rows_of_awkward_tables(docs, empty):
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns
    assert simhash.keep_one_similar(empty).count() == 0


def test_the_pivot_table_names_candidates(spark, monkeypatch):
    """Without any band that texts could share, close fingerprints still make near-copies meet, through the table of distances."""
    seen, table = [], simhash.pivot_table
    monkeypatch.setattr(simhash, "pivot_table", lambda *a: seen.append(1) or table(*a))
    monkeypatch.setattr(simhash, "tune_bands", lambda *a: (1, 60))
    rng = random.Random(3)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    kept = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and kept >= {2 * i for i in range(12)} and len(kept) <= 18
