"""Every registered SQL-checked query equals its DuckDB oracle (sf0.001),
the control totals of FIXTURES.md hold at sf0.01, and entry() runs."""

import duckdb
import pytest

import __spark_entry__ as E
from plume.plans import catalog
from plume.sources.tables import TABLES, table_path

from conftest import SF0001, SF001

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    return c


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = catalog.queries()[key](spark, SF0001)
    res = con.execute(SQL[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, df.collect()) == _canon(ocols, res.fetchall())


def test_every_key_has_oracle_except_ml():
    missing = set(catalog.queries()) - set(SQL)
    assert missing == {"train_relevance", "train_category", "evaluate_holdout", "evaluate_relevance", "best_candidate", "gated_ml"}


def test_entry_holds_the_catalog():
    assert set(catalog.queries()) <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


def test_control_totals_sf001(spark):
    from plume.sources.fixtures import enriched
    from plume.operators.aggregates import relevance_ratio, sentiment_overview
    e = enriched(spark, SF001)
    assert e.count() == 1000
    assert {r.predicted_sentiment: r["count"] for r in sentiment_overview(e).collect()} == \
        {"negative": 51, "neutral": 49, "others": 601, "positive": 299}
    assert {r.isProductRelated: r["count"] for r in relevance_ratio(e).collect()} == \
        {"Product Related": 800, "Not Product Related": 181}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["Predicted_Category", "mean_soe"]
