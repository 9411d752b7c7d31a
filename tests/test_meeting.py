"""Areas and counts over boxes that lie on one another, without a look at their pairs."""

import duckdb
import numpy as np
import pandas as pd
import pytest
import pytest

from cityloom.operators import dense
from cityloom.plans import registry


def plan(spark, name):
    return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def no_pairs(*_):
    raise AssertionError("pairs are looked at")


def odd_tables(folder):
    """Boxes of a few places in many sizes, some without a size or turned inside out, and one without a key."""
    con = duckdb.connect()
    for t, columns in {
        "part": "CASE WHEN i > 0 THEN (i // 3) * 1000 + i % 3 END AS p_partkey, CASE WHEN i % 50 = 7 THEN NULL WHEN i % 50 = 8 THEN -9 WHEN i % 50 = 9 THEN -1 ELSE 1 + (hash(i) % 50)::INT END AS p_size, 'type' AS p_type, 'Brand#' || (11 + i % 5) AS p_brand",
        "customer": "CASE WHEN i > 0 THEN (i // 3) * 1000 + i % 3 END AS c_custkey, CASE WHEN i % 50 <> 7 THEN (hash(i, 1) % 25)::INT END AS c_nationkey, 'use' AS c_mktsegment",
        "supplier": "i AS s_suppkey, 'name' AS s_name",
    }.items():
        con.sql(f"COPY (SELECT {columns} FROM range(600) t(i)) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same_rows(spark, folder, name):
    con = odd_tables(folder)
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(registry.ORACLE_SQL[name]).fetchall()))


def test_difference_area(spark, tmp_path):
    """A footprint's row is dealt out once: no join but the two that deal the cells' parts."""
    assert plan(spark, "difference_area").count("Join ") == 2
    same_rows(spark, tmp_path, "difference_area")


def brute(a, b, n, least, h, within):
    x, y = (np.minimum(a[:, None, k + 2], b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k]) for k in (0, 1))
    hit = (x > 0) & (y > 0) if within is None else (x >= -within[0]) & (y >= -within[1])
    return (hit if least is None else hit & (h[None, :] >= least[:, None])) @ n


@pytest.mark.parametrize("marks", [20, 500, 1 << 24])
@pytest.mark.parametrize("whole", [True, False])
def test_counts(monkeypatch, marks, whole):
    monkeypatch.setattr(dense, "MARKS", marks)
    random = np.random.default_rng(1)

    def boxes(k):
        place, size = random.uniform(0, 60, (k, 2)), random.uniform(1, 20, (k, 2))
        return np.c_[place, place + size] if not whole else np.c_[place // 1, place // 1 + size // 1]

    for k, m in ((1, 1), (5, 0), (60, 80), (200, 300)):
        a, b, n = boxes(k), boxes(m), random.integers(1, 5, m).astype(float)
        h, least = random.integers(0, 9, m).astype(float), random.integers(-1, 11, k).astype(float)
        for within in (None, (0, 0), (3, 1)):
            assert (dense.meeting(a, b, n, within=within) == brute(a, b, n, None, h, within)).all()
            assert (dense.meeting(a, b, n, least, h, within) == brute(a, b, n, least, h, within)).all()
    distinct, _ = dense.once(boxes(300) // 15)
    held = [any((r != s).any() and (r[:2] == s[:2]).all() and (s[2:] <= r[2:]).all() for r in distinct) for s in distinct]
    assert (dense.outer_of(distinct) != held).all()


def test_road_clearance(spark, tmp_path):
    """The outer outlines of a corner are found in the cells, not by a join of all."""
    assert plan(spark, "road_clearance").count("Join ") == 2
    same_rows(spark, tmp_path, "road_clearance")


@pytest.mark.parametrize("reach", range(9))
def test_steps(reach):
    for x in range(reach + 3):
        for y in range(reach + 3):
            assert sum(sign for sign, i, j in dense.steps(reach) if x <= i and y <= j) == (x * x + y * y <= reach * reach)


def test_party_walls(spark, monkeypatch):
    """No pairs are looked at; where sides are no whole numbers, they give the same rows. The kernel is called here, not by workers."""
    monkeypatch.setattr(dense, "blocks", no_pairs)
    random = np.random.default_rng(2)
    place, size = random.integers(0, 60, (400, 2)), random.integers(1, 20, (400, 2))
    box, h = np.c_[place, place + size].astype(float), random.integers(0, 9, 400).astype(float)
    kernel = {}
    monkeypatch.setattr(dense, "met", lambda a, b, f, *_: kernel.update(f=f))
    dense.party_walls(spark.createDataFrame([(1, 0, 0, 1, 1, 1)], "id long, x0 long, y0 long, x1 long, y1 long, h long"), 3, 1)
    rows = pd.DataFrame(box, columns=dense.BOX).assign(id=np.arange(400), h=h, n=1)
    got = kernel["f"](rows, rows).set_index("id")["neighbours"]
    x, y = (np.minimum(box[:, None, k + 2], box[None, :, k + 2]) - np.maximum(box[:, None, k], box[None, :, k]) for k in (0, 1))
    want = ((np.minimum(x, 0) ** 2 + np.minimum(y, 0) ** 2 <= 9) & (h[None, :] >= h[:, None] - 1)).sum(axis=1) - 1
    assert got.to_dict() == {i: n for i, n in enumerate(want.tolist()) if n}
    monkeypatch.undo()
    monkeypatch.setattr(dense, "met", lambda a, b, f, *_: kernel.update(f=f))
    dense.party_walls(spark.createDataFrame([(1, 0, 0, 1, 1, 1)], "id long, x0 long, y0 long, x1 long, y1 long, h long"), 0.75, 1)
    rows[dense.BOX] /= 4
    assert kernel["f"](rows, rows).set_index("id")["neighbours"].sort_index().to_dict() == got.to_dict()


CELLS_KNOWN = ["lend_fields", "parts_to_host"]


@pytest.mark.parametrize("name", CELLS_KNOWN)
def test_cells_are_known(spark, name):
    """Few cells are counted once, before, and met by a broadcast: no join of all footprints with their cells."""
    text = plan(spark, name)
    assert text.count("strategy=broadcast") == 2 and "max(greatest" not in text


@pytest.mark.parametrize("name", CELLS_KNOWN)
@pytest.mark.parametrize("cells", [0, 4096])
def test_more_cells(spark, monkeypatch, tmp_path, name, cells):
    monkeypatch.setattr(dense, "CELLS", cells)
    monkeypatch.setattr(dense, "PART", 50)
    same_rows(spark, tmp_path, name)
