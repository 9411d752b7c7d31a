"""Every query that has SQL gives the rows that DuckDB gives."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from cityloom.plans import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def table(rows):
    return sorted(repr([plain(r[k]) for k in sorted(r)]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = registry.QUERIES[name](spark, str(SF)).toArrow()
    want = db.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert table(got.to_pylist()) == table(want.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0
