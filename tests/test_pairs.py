"""Queries that return pairs of boxes: distinct boxes are met in cells, and their pairs are written in batches."""

import duckdb
import numpy as np
import pytest

from cityloom.operators import dense
from cityloom.plans import registry

NAMES = ["containment_pairs", "overlap_pairs"]


@pytest.mark.parametrize("name", NAMES)
def test_no_join_by_cell(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "cx" not in plan


def test_batches(monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 10)
    sizes = np.array([3, 7, 1, 25, 0, 9, 2, 10])
    slices = list(dense.runs(sizes))
    assert [k for s in slices for k in range(len(sizes))[s]] == list(range(len(sizes)))
    assert all(sizes[s].sum() <= 10 or len(sizes[s]) == 1 for s in slices)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("sizes", [2, 50])
def test_same_pairs(spark, tmp_path, name, sizes):
    """Boxes of a few places, many of them copies or of all sizes."""
    con = duckdb.connect()
    for t, columns in {
        "part": f"(i // 3) * 1000 + i % 3 AS p_partkey, 12 + (hash(i) % {sizes})::INT AS p_size, 'type' AS p_type, 'brand' AS p_brand",
        "customer": f"(i // 3) * 1000 + i % 3 AS c_custkey, (hash(i, 1) % {sizes})::INT AS c_nationkey, 'use' AS c_mktsegment",
        "supplier": "i AS s_suppkey, 'name' AS s_name",
    }.items():
        con.sql(f"COPY (SELECT {columns} FROM range(300) t(i)) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    assert sorted(got) == sorted(want) and want
