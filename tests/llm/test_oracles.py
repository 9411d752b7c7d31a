"""The registered queries: SQL's rows where there is SQL, and their contracts' laws on whole tables."""

import os
import zlib
from pathlib import Path

import duckdb
import pytest

from cityloom.llm import queries

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(table):
    return sorted(repr([r[k] for k in sorted(r)]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = queries.QUERIES[name](spark, str(SF)).toArrow()
    want = db.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got) == rows(want)


def test_sharding_law(spark, db):
    got = queries.QUERIES["op3_ring_shards"](spark, str(SF)).toPandas()
    docs = db.sql("SELECT doc_id, coalesce(text, '') AS text FROM documents").df()
    want = {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert set(zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want and len(got) == len(docs)
    n = got.shard.value_counts()
    assert set(got.law) == {"rows"} and sorted(n.index) == list(range(16)) and n.max() - n.min() <= 1 and got.grown_shard.isna().all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_mixing_laws(spark, db):
    got = queries.QUERIES["op4_mix_sources"](spark, str(SF)).toPandas()
    size = db.sql(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, source FROM documents").df()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == dict(zip(size.doc_id, size.n, strict=True))
    assert (got.taken <= 3 * got["size"]).all()
    by = got.merge(size, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1).all()
    again = queries.QUERIES["op4_mix_sources"](spark, str(SF)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
