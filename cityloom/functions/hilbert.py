"""Order along a Hilbert curve, as one expression: a fold over the levels of the square."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert(x: str, y: str, bits: int = 8) -> Column:
    """Place along the curve of the cell (x, y) of a 2^bits square; cells outside take the nearest one's. Each level adds the
    quadrant's place times its area, then turns the quadrant to the curve's frame."""
    top = (1 << bits) - 1
    start = f"named_struct('x', cast(greatest(0, least({top}, {x})) as bigint), 'y', cast(greatest(0, least({top}, {y})) as bigint), 'd', 0L)"
    rx, ry = "if((q.x & s) > 0, 1L, 0L)", "if((q.y & s) > 0, 1L, 0L)"
    step = f"""named_struct(
        'x', if({ry} = 1, q.x, if({rx} = 1, s - 1 - q.y, q.y)), 'y', if({ry} = 1, q.y, if({rx} = 1, s - 1 - q.x, q.x)),
        'd', q.d + s * s * ((3 * {rx}) ^ {ry}))"""
    sides = ", ".join(f"{1 << k}L" for k in reversed(range(bits)))
    return F.expr(f"aggregate(array({sides}), {start}, (q, s) -> {step}, q -> q.d)")


def hilbert_sql(table: str, x: str, y: str, bits: int = 8) -> str:
    """The same as common table expressions for DuckDB, a level each; the last is hilbert(id, place)."""
    out = [f"h{bits} AS MATERIALIZED (SELECT id, CAST({x} AS BIGINT) AS hx, CAST({y} AS BIGINT) AS hy, 0::BIGINT AS d FROM {table})"]
    for k in reversed(range(bits)):
        s = 1 << k
        out.append(f"""r{k} AS MATERIALIZED (SELECT *, CASE WHEN (hx & {s}) > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN (hy & {s}) > 0 THEN 1 ELSE 0 END AS ry FROM h{k + 1}),
        h{k} AS MATERIALIZED (SELECT id, CASE WHEN ry = 1 THEN hx WHEN rx = 1 THEN {s - 1} - hy ELSE hy END AS hx, CASE WHEN ry = 1 THEN hy WHEN rx = 1 THEN {s - 1} - hx ELSE hx END AS hy, d + {s * s} * xor(3 * rx, ry) AS d FROM r{k})""")
    return ", ".join(out) + ", hilbert AS (SELECT id, CAST(d AS BIGINT) AS place FROM h0)"
