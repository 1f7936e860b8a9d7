"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from dispersa.plans import axis_queries, class_queries, cluster_queries, registry, resampling_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(autouse=True)
def few_draws(monkeypatch):
    """Registered queries run with all their draws elsewhere; here a few show that they run."""
    monkeypatch.setattr(resampling_queries, "DRAWS", 30)
    monkeypatch.setattr(resampling_queries, "RELABELLINGS", 30)
    monkeypatch.setattr(axis_queries, "SPECTRUM_DRAWS", 20)
    monkeypatch.setattr(class_queries, "RANDOM_SETS", 50)
    monkeypatch.setattr(cluster_queries, "ERROR_DRAWS", 30)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return f"{float(v) + 0.0:.5f}" if not isinstance(v, (str, bool)) and not hasattr(v, "isoformat") and not isinstance(v, bytes) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    out = registry.queries()[name](spark, SF)
    # these tables have no planted axis; test_operators.py finds one in data that has
    assert out.count() > 0 or name == "x8_candidate_axes" and out.columns == ["rank", "eigenvalue", "share", "participation"]
