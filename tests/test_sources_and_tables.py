"""Published sources from raw ids to the shared layout, score tables, level sets and validated axes."""

import numpy as np
import pytest

from dispersa.operators import agreement, axes, fitting, sequences, spectra


@pytest.fixture(scope="module")
def published(spark):
    rng = np.random.default_rng(11)
    rows = []
    for source, k in (("S1", 2.0), ("S2", 0.7)):
        y = {f"G{i}": rng.negative_binomial(k, k / (k + m), 120) for i, m in enumerate((2.0, 5.0, 9.0))}
        y["old.name"], y["nowhere"] = rng.poisson(1.0, 120), rng.poisson(1.0, 120)
        y["G9"] = np.where(np.arange(120) < 3, 9, 0)  # too few units
        rows += [(source, g, f"u{j}", int(v[j])) for g, v in y.items() for j in range(120) if v[j]]
    rows += [("S1", "G0", "poor", 1)]
    aliases = [("old.name", "G.1", 2), ("old.name", "G1", 1)]
    return spark.createDataFrame(rows, "source string, id string, unit string, y long"), spark.createDataFrame(aliases, "alias string, feature string, ord int"), rows


def test_fit_sources_is_the_fit_of_what_is_left(spark, published):
    counts, aliases, rows = published
    kept = agreement.source_counts(counts, aliases, "^G[0-9]$", 4, 10)
    summed = {}
    for s, g, u, y in rows:
        name = {"old.name": "G1", "nowhere": None}.get(g, g)
        if name:
            summed[s, name, u] = summed.get((s, name, u), 0) + y
    lib = {}
    for (s, _, u), y in summed.items():
        lib[s, u] = lib.get((s, u), 0) + y
    want = {k: y for k, y in summed.items() if lib[k[0], k[2]] >= 4 and k[1] != "G9"}
    assert {(r.dataset, r.feature, r.unit): r.y for r in kept.collect()} == want
    units = agreement.relative_exposures(kept).collect()
    for s in ("S1", "S2"):
        assert np.mean([u.expo for u in units if u.dataset == s]) == pytest.approx(1.0)
    got = {(r.source, r.feature): r for r in agreement.fit_sources(counts, aliases, "^G[0-9]$", 4, 10).collect()}
    assert set(got) == {(s, f"G{i}") for s in ("S1", "S2") for i in range(3)}
    plain = fitting.fit_dispersions(kept, agreement.relative_exposures(kept)).collect()
    for r in plain:
        row = got[r.dataset, r.feature]
        assert (row.mean, row.disp) == pytest.approx((r.mu, r.disp)) and row.cv2 == pytest.approx(r.disp + 1 / r.mu)
    assert got["S2", "G2"].disp > got["S1", "G2"].disp
    assert agreement.fit_sources(counts.limit(0), aliases, "^G", 4, 10).count() == 0


def test_score_table_counts_from_the_gene(spark):
    seqs = spark.createDataFrame([("a", "CCTATAGGAAAAC", True), ("b", "CG", None)], "gene string, seq string, extended boolean")
    motif = spark.createDataFrame([("a", 2.5, 3, 4), ("b", None, None, 4)], "gene string, score double, pos int, width int")
    got = {r.gene: r for r in sequences.score_table(seqs, "gene", motif, sequences.longest_run(seqs, "gene")).collect()}
    a, b = got["a"], got["b"]
    assert (a.prom_len, a.prom_extended, a.tata_score, a.tata_pos, a.tata_motif) == (13, True, 2.5, 11, "TATA")
    assert (a.polyat_len, a.polyat_pos, a.polyat_tract) == (4, 5, "AAAA")
    assert (b.prom_len, b.prom_extended, b.tata_pos, b.tata_motif, b.polyat_len, b.polyat_pos, b.polyat_tract) == (2, False, None, None, 0, None, None)


def test_level_sets(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)] + [(99, None)], "feature int, s double")
    got = {}
    for r in axes.level_sets(df, "feature", "s", "intr").collect():
        got.setdefault(r.set_name, set()).add(r.feature)
    assert got == {"intr_low": {0, 1, 2}, "intr_average": {3, 4, 5}, "intr_high": {6, 7, 8}}


def test_validated_axes_adjust_over_candidates_only(spark):
    tests = spark.createDataFrame([("cis", k, 1.0 / k, p) for k, p in ((1, 0.01), (2, 0.04), (3, 0.9), (4, 0.001))], "part string, rank int, value double, p double")
    candidates = spark.createDataFrame([("cis", 1), ("cis", 2), ("cis", 2), ("trans", 3)], "part string, rank int")
    got = {r["rank"]: r for r in spectra.validated_axes(tests, candidates).collect()}
    assert {k: (r.q, r.validated) for k, r in got.items()} == {1: (0.02, True), 2: (0.04, True)}
