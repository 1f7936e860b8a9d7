"""Language model, quality, toxicity and paragraphs, and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from dispersa.llm import common, lm, paragraphs, quality, toxicity

SF = "/root/testdata/sf0.01"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=80), st.lists(st.integers(0, 2**63), max_size=20))
def test_elias_fano(tmp_path_factory, values, queries):
    v = np.sort(np.array(values, np.uint64))
    q = np.sort(np.array(queries + values[:5], np.uint64))
    e = lm.EliasFano(v, str(tmp_path_factory.mktemp("ef")), "x")
    assert (e.decode(0, len(v)) == v).all()
    assert (e.successor(q)[0] == np.searchsorted(v, q)).all()


@pytest.mark.parametrize("tokens", [300, lm.SHARD_TOKENS])
def test_language_scores(docs, awkward, monkeypatch, tokens):
    monkeypatch.setattr(lm, "SHARD_TOKENS", tokens)
    words = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, [*(t or "").encode().lower().split(), 0]) for d, t, *_ in awkward]
    uni, pair, texts = Counter(), Counter(), 0
    for _, out, w in words:
        if not out:
            uni.update(w)
            pair.update(zip([1, *w], w, strict=False))
            texts += 1
    n, v = sum(uni.values()), len(uni)
    want = []
    for d, out, w in words:
        base = score = 0.0
        for before, x in zip([1, *w], w, strict=False):
            p = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10((pair[before, x] + lm.KAPPA * p) / ((texts if before == 1 else uni[before]) + lm.KAPPA))
        want.append((str(d), out, len(w), sum(x in uni for x in w), n, base, score))
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.language_scores(docs).collect()), key=lambda r: r[:6])
    for a, b in zip(got, sorted(want, key=lambda r: r[:6]), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 3e-4 * a[2] + 1e-6


def test_language_scores_of_an_empty_table(empty):
    assert lm.language_scores(empty).count() == 0


def held(docs, labels, column, modulus, out):
    rows = docs.join(labels, "doc_id").select("doc_id", column).collect()
    return {r[0]: r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == out}


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = held(docs, labels, "quality", 3, 1)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    right = [got[d].predicted == y for d, y in truth.items()]
    assert sum(right) / len(right) > 0.95
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    truth = held(docs, labels, "toxic", 4, 2)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    clean = [got[d].predicted for d, y in truth.items() if y == 0]
    bad = [got[d].predicted for d, y in truth.items() if y == 1]
    assert sum(clean) / len(clean) < 0.05 and sum(bad) / len(bad) > 0.5


def test_folding_and_exceptions():
    assert toxicity.fold("Stуpid 1D10T $cum, 3 pаth3tic") [1:] == ["idiot", "scum", "e", "pathetic"]
    x = toxicity.Lexicon({"kill": 2.0, "scum*": 1.0}, ["kill process"])
    a = x.automaton()
    assert [w for *_, w in x.matches(a, ["kill", "process", "kill", "scumbag", "overkill"])] == [2.0, 1.0]


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_awkward_and_no_rows(spark, docs, empty, scores):
    labels = spark.createDataFrame([(35, 1, 0), (42, 1, 0), (77, 0, 1), (84, 0, 1), (None, 1, 1), (91, None, None), (98, 0, 0)], "doc_id long, quality int, toxic int")
    got = scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert scores(empty, labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == docs.count()


def brute_blocks(text):
    """(start, words) of the blocks of a text, by definition."""
    w = (text or "").encode().lower().split()
    h = [int.from_bytes(hashlib.md5(x).digest()[8:], "little") for x in w]
    out = []
    for size, reach in ((12, 5), (60, 30)):
        for i in range(len(w) - size + 1):
            if i == 0 and size == 12 or h[i] < min(h[max(0, i - reach) : i], default=1 << 64) and h[i] <= min(h[i : i + reach + 1]):
                out.append((i, tuple(w[i : i + size]), size == 60))
    if 0 < len(w) < 60:
        out.append((0, tuple(w), len(w) >= 5))
    return out


def brute_paragraphs(rows, similarity=0.8):
    occ, banded = defaultdict(set), set()
    for d, t in rows:
        for i, w, similar in brute_blocks(t):
            occ[w].add((d is not None, d or 0, i))
            banded |= {w} if similar else set()
    keys = list(occ)
    sets = [{k[i : i + 5] for i in range(len(k) - 4)} for k in keys]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if keys[i] in banded and keys[j] in banded:
                n = len(sets[i] & sets[j])
                if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, k in enumerate(keys):
        groups[find(i)] |= {(*o, len(k)) for o in occ[k]}
    out = set()
    for g in groups.values():
        there, d, i, _ = min(g)
        first = d if there else None
        if len(g) > 1:
            out |= {(d if there else None, s, n, first, i, n >= 12 and (d if there else None, s) != (first, i)) for there, d, s, n in g}
    return out


@pytest.mark.parametrize("bucket", [1, paragraphs.BUCKET])
def test_repeated_paragraphs(docs, awkward, monkeypatch, bucket):
    monkeypatch.setattr(paragraphs, "BUCKET", bucket)
    got = paragraphs.repeated_paragraphs(docs, recall=0.9999).collect()
    assert len(set(got)) == len(got)
    assert {tuple(r) for r in got} == brute_paragraphs([(d, t) for d, t, *_ in awkward])


def test_passages_within_lines_are_caught():
    rng = np.random.Generator(np.random.Philox(31))
    caught = 0
    for _ in range(300):
        passage = [f"p{x}" for x in rng.integers(0, 10**6, 51)]
        texts = [" ".join([f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 60))] + passage + [f"v{x}" for x in rng.integers(0, 10**6, 40)]) for _ in range(2)]
        a, b = ({w for _, w, _ in brute_blocks(t)} for t in texts)
        caught += bool(a & b)
    assert caught >= 0.95 * 300


@pytest.mark.parametrize(("words", "edited", "least"), [(5, 0, 1.0), (8, 0, 1.0), (12, 0, 1.0), (19, 0, 1.0), (40, 1, 0.95), (59, 1, 0.95), (59, 2, 0.9)])
def test_recall_of_whole_short_texts(spark, words, edited, least):
    """Texts of one paragraph and copies of them, with edits that leave a similarity of 0.8."""
    rng = np.random.Generator(np.random.Philox(words))
    rows = []
    for n in range(100):
        text = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        copy = list(text)
        for x in range(edited):
            copy[x if words > 50 else words - 1 - x] = f"e{n}"
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.kept_doc_id, r.doc_id) for r in got}
    assert sum((2 * n, 2 * n + 1) in pairs for n in range(100)) >= 100 * least


@pytest.mark.parametrize(("words", "edited"), [(25, 0), (30, 0), (30, 1), (40, 1), (60, 1), (80, 1), (100, 2), (200, 4)])
def test_recall_of_passages_by_size_and_edits(words, edited):
    """Passages set into different texts, edited so that a similarity of 0.8 is left: some whole block is the same in both."""
    rng = np.random.Generator(np.random.Philox(100 * words + edited))
    caught = 0
    for _ in range(300):
        passage = [f"p{x}" for x in rng.integers(0, 10**6, words)]
        texts = []
        for changes in (0, edited):
            own = list(passage)
            for x in range(changes):
                own[(words // 8 if words == 30 else words // (edited + 1)) * (x + 1)] = f"e{x}"
            texts.append(" ".join([f"w{x}" for x in rng.integers(0, 10**6, rng.integers(5, 60))] + own + [f"v{x}" for x in rng.integers(0, 10**6, 40)]))
        a, b = ({w for _, w, _ in brute_blocks(t)} for t in texts)
        caught += bool(a & b)
    assert caught >= 0.9 * 300


def test_paragraphs_of_null_and_repeated_ids(spark):
    rng = np.random.Generator(np.random.Philox(21))
    rows = []
    for n in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 70)]
        own = [f"v{x}" for x in rng.integers(0, 5000, 30)]
        rows += [(None if n % 2 else 7, " ".join(words)), (None if n % 3 else 8, " ".join(own)), (100 + n, " ".join([*words[:58], "end", *words[59:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in paragraphs.repeated_paragraphs(docs).collect() if r.doc_id is not None and r.doc_id >= 100}
    assert got == {100 + n for n in range(60)}


def test_removed_paragraphs_go(spark):
    rng = np.random.Generator(np.random.Philox(4))
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 80))
    short = "a text of less than twenty words in all"
    own = " ".join(f"own{i}" for i in range(70)) + "\n"
    rows = [(1, passage, "a"), (2, own + passage + "\nand  an end", "b"), (3, None, "c"), (None, passage, "d"), (None, short, "e"), (None, "kept whole", "f"), (5, short, "g"), (6, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = paragraphs.remove_paragraphs(docs)
    assert out.columns == docs.columns
    got = {r.removed: r.text for r in out.collect()}
    assert got["d"] == passage and got["e"] == got["g"] == short and got["f"] == "kept whole" and got["c"] is None and got["h"] == ""
    for r in ("a", "b"):
        assert sum(w[0] == "p" for w in got[r].split()) < 0.6 * 80 or r == "a"
    assert got["b"].startswith(own) and got["b"].endswith("and  an end")


def test_paragraphs_of_an_empty_table(empty):
    assert paragraphs.repeated_paragraphs(empty).count() == 0
    assert paragraphs.remove_paragraphs(empty).count() == 0


def test_components(spark):
    rng = np.random.Generator(np.random.Philox(9))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_pipeline_stages_take_effect(spark):
    docs, sizes = common.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialise(stage(spark, docs, SF))
        sizes.append(docs.count())
        assert docs.columns == before.columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert sizes[0] < common.documents(spark, SF).count() and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, pieces.drop("sequence_id", "offset").collect()))


def test_pipeline_keeps_extra_columns_rows_without_ids_and_empty_tables(spark):
    docs = common.documents(spark, SF).where("doc_id < 150").drop("lang", "source")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    fresh = " ".join(f"word{i}" for i in range(40)) + "."
    more = spark.createDataFrame([(None, f"It was so. {item}"), (None, fresh), (None, None), (None, "")], "doc_id long, text string")
    docs = docs.unionByName(more.selectExpr("*", "cast(length(text) as long) AS n_chars"))
    docs = docs.selectExpr("*", "'x' AS `_h`", "1 AS th", "'t' AS row", "2.5D AS `a.b`", "doc_id AS id")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, SF))
        assert docs.columns == before.columns
    held = [r.text for r in docs.where("doc_id IS NULL").collect()]
    assert fresh in held and not any(item in (t or "") for t in held)
    assert {tuple(r) for r in docs.select("_h", "th", "row", "`a.b`").distinct().collect()} == {("x", 1, "t", 2.5)}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
