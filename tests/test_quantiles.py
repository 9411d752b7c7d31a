"""zonal_percentiles gives the bits of its SQL where the spread is 100 but for rounding."""

import duckdb

from cityloom.plans import registry


def test_bits(spark, tmp_path):
    # of three values the percentiles lie 0.8 * (last - first) apart; further, plain lists, nulls, and nothing but nulls
    duckdb.sql(f"""COPY (SELECT u AS user_id, (u * 7.13 + 0.37 + CASE i WHEN 0 THEN 0 WHEN 1 THEN hash(u) % 12500 / 100.0 ELSE 125 END)::DOUBLE AS value FROM range(400) s(u), range(3) t(i)
        UNION ALL SELECT 1000 + u, round(hash(u, i) % 40000 / 100.0, 2) FROM range(200) s(u), range(9) t(i) WHERE i <= u % 9
        UNION ALL SELECT u, NULL FROM range(0, 1300, 3) s(u)) TO '{tmp_path}/events.parquet'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(registry.ORACLE_SQL["zonal_percentiles"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["zonal_percentiles"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
