"""Every query with SQL against that SQL, and the others for rows."""

import math

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-3)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    keys = [c for c in ("series_id", "fold", "t", "h", "term", "metric", "name", "query_idx", "key_idx") if c in cols]
    order = lambda rows: sorted(rows, key=lambda r: tuple(str(r[cols.index(k)]).zfill(12) for k in keys))
    got = order([tuple(r[c] for c in cols) for r in df.collect()])
    rel = db.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    want = order(db.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall())
    assert len(got) == len(want) > 0
    assert all(near(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_attention_is_over_whole_series(spark, monkeypatch):
    """The scores are fitted on every week, for as long as the operator's default says."""
    seen = {}
    monkeypatch.setattr(queries.neural, "attention_scores", lambda design, *a, **k: seen.update(k, rows=design.count()))
    queries.QUERIES["attention_scores"](spark, SF)
    assert seen == {"rows": queries.sources.ship_weekly(spark, SF).count()}
