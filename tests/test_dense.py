"""Tables whose boxes lie on one another: the rows of SQL on small ones, and no work that grows as the pairs on larger ones."""

import time
from pathlib import Path

import duckdb
import pytest

from cityloom.plans import registry

#: Rows of part and customer in one place, seconds that a query may take over them.
STACKED, LIMIT = 30_000, 60
CASES = [
    "tile_round_trip",
    "topk_disagreement",
    "quality_report",
    "deck_rule",
    "party_walls",
    "copied_heights",
    "difference_area",
    "road_clearance",
    "overlay_heights",
    "anti_by_share",
    "spatial_intersects",
    "duplicate_carriageways",
    "merged_masses",
    "cantilevers",
    "nested_base",
    "container_drop",
    "dedupe90",
    "nearest_other_point",
    "nearest_within",
    "compare_report",
    "parts_to_host",
    "lend_fields",
    "attach_attributes",
    "best_match_iou",
]


def table(rows):
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in sorted(r)]) for r in rows)


def stacked(folder: Path, rows: int, places: int) -> str:
    """part, customer and supplier with all keys in a few of the 1,000 places."""
    key = f"i // {places} * 1000 + i % {places}"
    for name, columns in {
        "part": f"{key} AS p_partkey, 1 + i * 7 % 50 AS p_size, 'type' AS p_type, 'Brand#' || (11 + i % 5) AS p_brand",
        "customer": f"{key} AS c_custkey, i * 3 % 25 AS c_nationkey, CASE WHEN i % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS c_mktsegment",
        "supplier": f"{key} AS s_suppkey, 'name' || i AS s_name",
    }.items():
        duckdb.sql(f"COPY (SELECT {columns} FROM range({rows}) t(i)) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", CASES)
def test_same_rows(spark, tmp_path, name):
    folder = stacked(tmp_path, 400, 3)
    db = duckdb.connect()
    for t in ("part", "customer", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, folder).toArrow()
    want = db.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert table(got.to_pylist()) == table(want.to_pylist())


@pytest.mark.parametrize("name", CASES)
def test_one_place(spark, tmp_path, name):
    folder = stacked(tmp_path, STACKED, 1)
    began = time.monotonic()
    registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < LIMIT
