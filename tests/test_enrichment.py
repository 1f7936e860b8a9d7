"""Normalised enrichment scores against walks of the same random sets."""

import re
import zlib

import numpy as np
import pytest

from dispersa.operators import enrichment


def walk(scores, inside):
    """Extreme of the weighted running sum, step by step."""
    w = np.abs(scores)
    total, miss = w[inside].sum(), len(scores) - inside.sum()
    x, best, worst = 0.0, 0.0, 0.0
    for hit, v in zip(inside, w):
        x += v / total if hit else -1 / miss
        best, worst = max(best, x), min(worst, x)
    return best if best >= -worst else worst


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.Generator(np.random.Philox(4))
    scores = np.sort(rng.normal(size=120))[::-1]
    sets = {"top": np.arange(0, 16, 2), "bottom": np.arange(100, 120, 3), "mixed": rng.choice(120, 8, replace=False), "one": np.array([60])}
    ranks = spark.createDataFrame([("a", f"f{i:03d}", float(v)) for i, v in enumerate(scores)], "list string, feature string, score double")
    terms = spark.createDataFrame([(t, f"f{i:03d}") for t, x in sets.items() for i in x] + [("none", "zzz")], "term string, feature string")
    return scores, sets, ranks, terms


@pytest.mark.parametrize("together", [500, 7])
def test_scores_p_and_normalisation(lists, monkeypatch, together):
    scores, sets, ranks, terms = lists
    monkeypatch.setattr(enrichment, "SETS_TOGETHER", together)
    monkeypatch.setattr(enrichment, "ELEMENTS_TOGETHER", 1000)
    got = {r.term: r for r in enrichment.normalised_scores(ranks, terms, 60, 3).collect()}
    assert set(got) == set(sets)
    for t, at in sets.items():
        inside = np.isin(np.arange(120), at)
        es = walk(scores, inside)
        key = zlib.crc32(f"a\0{len(at)}".encode()) << 20 | 3
        null = np.array([walk(scores, np.isin(np.arange(120), np.random.Generator(np.random.Philox(key=[key, d])).choice(120, len(at), replace=False, shuffle=False))) for d in range(60)])
        same = null[(null >= 0) == (es >= 0)]
        assert got[t].es == pytest.approx(es) and got[t]["size"] == len(at)
        assert got[t].nes == pytest.approx(es / np.abs(same).mean()) and got[t].p == pytest.approx((1 + (np.abs(same) >= abs(es) - 1e-12).sum()) / (1 + len(same)))
    assert max(got, key=lambda t: got[t].nes) == "top" and got["top"].p < 0.05 and got["bottom"].nes < -1.5


def test_no_terms(lists):
    _, _, ranks, terms = lists
    assert enrichment.normalised_scores(ranks, terms.limit(0), 10).collect() == []


def test_random_sets_are_dealt_to_several_tasks(lists):
    """A few small rows would otherwise be put into one task that draws all sets."""
    _, _, ranks, terms = lists
    plan = enrichment.normalised_scores(ranks, terms, 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[list#\d+, _c#\d+\], \d+", plan)
