"""Components: edges are contracted in lots before labels fall in rounds."""

import random

import numpy as np
import pytest

from cityloom.operators import network


def plain(nodes, edges):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        low[q] = p
    return {n: root(n) for n in nodes}


def test_least_of_each():
    rng = random.Random(5)
    for n, m in ((1, 0), (40, 15), (200, 150), (300, 900)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        a, b = np.array(edges, int).reshape(-1, 2).T
        assert dict(enumerate(network.least_of_each(a, b, n).tolist())) == plain(range(n), edges)


@pytest.mark.parametrize("together", [False, True])
def test_lots_meet(spark, together):
    """Edges of far ids, so that most nodes are in several lots; nodes without edges stay their own."""
    rng = random.Random(6)
    nodes, edges = list(range(-20, 900)), [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = network.component_ids(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame([(*e, 1.0) for e in edges], "a long, b long, length double"), together)
        assert {r["id"]: r["component"] for r in got.collect()} == plain(nodes, edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(network, "cut", lambda df, cut=network.cut: cuts.append(1) or cut(df))
    edges = spark.range(3000).selectExpr("id as a", "id + 1 as b", "1.0D as length")
    got = network.component_ids(spark.range(3001), edges)
    assert got.where("component <> 0").count() == 0 and got.count() == 3001 and len(cuts) <= 8
