"""Each query against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from ambercol.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    found, said = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(said.columns)
    assert columns == sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in said.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["returns", "ind_returns", "ind_roc"])
def test_zeros_and_ties_as_in_sql(spark, tmp_path, name):
    """0 over 0 is NaN and no row before is NULL; the ties and the sign of zero are those of SQL's rounding."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT row_number() OVER () - 1 AS event_id, unnest([16.0, 16.01, 0, 0, 0, 0, 0, 3, 40, 20.35, 74.76, 51, 40000, 39999.9, 1e-4, 0.1, 160, 91.5])::DOUBLE AS value) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    said = con.execute(f"SELECT x FROM ({SQL[name]}) ORDER BY event_id").fetchall()
    assert [repr(r.x) for r in QUERIES[name](spark, str(tmp_path)).orderBy("event_id").collect()] == [repr(x) for (x,) in said]
