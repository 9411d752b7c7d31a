"""Queries on the best match: a footprint's row is dealt out once, with no join by its box or id but to keep those without a match."""

import duckdb
import pytest

from cityloom.plans import registry

#: Joins of the optimised plan: two deal the cells' parts, the others look up b's columns and keep footprints without a match.
JOINS = {"best_match_iou": 2, "parts_to_host": 2, "lend_fields": 4, "attach_attributes": 4, "compare_report": 4}


@pytest.mark.parametrize("name", JOINS)
def test_joins(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == JOINS[name] and "FlatMapCoGroupsInPandas" in plan  # pairs are looked at in cells, not rows of the plan


@pytest.mark.parametrize("name", JOINS)
def test_many_sizes(spark, tmp_path, name):
    """Boxes of a few places in all their sizes, many of equal common area."""
    for t, columns in {
        "part": "(i // 3) * 1000 + i % 3 AS p_partkey, 1 + (hash(i) % 50)::INT AS p_size, 'type' AS p_type, 'Brand#' || (11 + i % 5) AS p_brand",
        "customer": "(i // 3) * 1000 + i % 3 AS c_custkey, (hash(i, 1) % 25)::INT AS c_nationkey, CASE WHEN i % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS c_mktsegment",
        "supplier": "i AS s_suppkey, 'name' AS s_name",
    }.items():
        duckdb.sql(f"COPY (SELECT {columns} FROM range(1500) t(i)) TO '{tmp_path}/{t}.parquet'")
    con = duckdb.connect()
    for t in ("part", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(registry.ORACLE_SQL[name]).fetchall()))
