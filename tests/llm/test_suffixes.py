"""Suffix arrays and byte removal, against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dispersa.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(rows, span):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone.update(range(i, i + span))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        runs = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((d, len(b), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group", [2, suffixes.GROUP])
def test_removal(spark, awkward, docs, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.remove_repeats(docs, kept="sha256").collect())
    assert got == brute([(r[0], r[1]) for r in awkward], suffixes.SPAN)


@pytest.mark.parametrize("group", [2, suffixes.GROUP])
def test_removal_with_short_spans_and_overlaps(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)] + [(99, "a" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.remove_repeats(df, span=12, gram=5, kept="sha256").collect())
    assert got == brute(rows, 12)


def test_long_text_is_worked_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BITS", 11)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, "".join(rng.choice("abcdefgh ") for _ in range(5000)) + passage), (2, passage[100:] + "".join(rng.choice("abc") for _ in range(100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.remove_repeats(df, kept="sha256").collect())
    assert got == brute(rows, 200)


def test_text_without_cut_characters_and_carried_columns(spark):
    s = "é" * 150
    df = spark.createDataFrame([(1, "a" + s, 5), (2, "b" + s + "ö", 6)], "doc_id long, text string, kept int")
    got = sorted((r.doc_id, r.kept, r.carried.kept) for r in suffixes.remove_repeats(df, kept="text", carry=["kept"]).collect())
    assert got == [(1, "a", 5), (2, "b", 6)]  # the first byte of ö ends a string that starts earlier in its text


def test_empty_table(empty):
    assert suffixes.remove_repeats(empty).count() == 0
