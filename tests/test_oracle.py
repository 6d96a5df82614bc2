"""Every registered query against its DuckDB oracle (the driver's check), at sf0.01."""

import math

import duckdb
import pytest

from conftest import SF01

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _spark_kind(dt):
    s = dt.simpleString()
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}.get(s, "TIMESTAMP" if s.startswith("timestamp") else s)


def _duck_kind(t):
    t = str(t)
    return "TIMESTAMP" if t.startswith("TIMESTAMP") else t


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    ocols, otypes = rel.columns, rel.types
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    # same column types on both sides (no HUGEINT sums, INT vs BIGINT, DECIMAL literals)
    skinds = {f.name: _spark_kind(f.dataType) for f in df.schema.fields}
    assert {c: skinds[c] for c in ocols} == {c: _duck_kind(t) for c, t in zip(ocols, otypes)}
    assert len(srows) == len(orows)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF01)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "grade" in df.columns
