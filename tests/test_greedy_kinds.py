"""Greedy matching by kinds of points and boxes: the pass over all pairs, without writing them."""

import random

import duckdb
import pandas as pd

from cityloom.operators import spatial
from cityloom.plans import registry


def test_copies_are_the_sequential_ones():
    rng = random.Random(7)
    for kinds in (1, 4, 9):
        ids = rng.sample(range(1000), 60)
        points = {ids[k]: sorted([ids[k], *ids[30 + k :: 10][:4]]) for k in range(kinds)}
        boxes = {900 + k: [2000 + 7 * j + k * 3 % 7 for j in range(rng.randint(1, 6))] for k in range(7)}
        met = [(p, b, rng.randint(0, 3)) for p in points for b in boxes if rng.random() < 0.6]
        want, ps, bs = set(), set(), set()
        for s, p, b, kind in sorted((s, i, j, p) for p, b, s in met for i in points[p] for j in boxes[b]):
            if (kind, p) not in ps and b not in bs:
                want.add((p, b, s))
                ps.add((kind, p))
                bs.add(b)
        got = spatial.greedy_of(pd.DataFrame(met, columns=["p", "b", "score"]), points, boxes)
        assert set(got) == want and len(got) == len(want)


def test_same_rows_without_the_pairs_of_copies(spark, tmp_path):
    con = duckdb.connect()
    for t, columns in {
        "customer": "(i // 9) * 1000 + i % 9 * 25 AS c_custkey, (hash(i, 1) % 25)::INT AS c_nationkey, 'use' AS c_mktsegment",
        "supplier": "(i // 9) * 1000 + i % 9 * 25 AS s_suppkey, 'name' AS s_name",
    }.items():
        con.sql(f"COPY (SELECT {columns} FROM range({120 if t == 'supplier' else 150}) t(i)) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    con.execute("CREATE VIEW part AS SELECT 1 AS p_partkey, 1 AS p_size, '' AS p_type, '' AS p_brand")
    df = registry.QUERIES["greedy_assign"](spark, str(tmp_path))
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    want = con.execute(registry.ORACLE_SQL["greedy_assign"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want
