"""Queries of rasters, networks, placement and packaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions.shapes import id_share
from cityloom.operators import network as N
from cityloom.operators import package as P
from cityloom.operators import raster as R
from cityloom.plans.entities import WITH, footprints, landmarks, outlines, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CENTRES = "generate_series(CAST(ceil({0}0 / 10.0 - 0.5) AS BIGINT), CAST(ceil({0}1 / 10.0 - 0.5) AS BIGINT) - 1)"
BURN = f"""SELECT i, j, arg_max(h, id) AS v FROM (SELECT id, h, i, unnest({CENTRES.format('y')}) AS j FROM (SELECT *, unnest({CENTRES.format('x')}) AS i FROM a)) GROUP BY 1, 2"""


def burned(spark, sf_dir):
    return R.burned(footprints(spark, sf_dir), 10, "h", "id")


@query(f"{WITH} {BURN}")
def rasterize_last_wins(spark, sf_dir):
    return burned(spark, sf_dir)


SQUARE = "WITH e AS (SELECT user_id AS i, CAST(event_id % 50 AS BIGINT) AS j, CAST(round(avg(value) * 8) AS BIGINT) AS v FROM events GROUP BY 1, 2)"


def field(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "value")
    return e.groupBy(F.col("user_id").alias("i"), (F.col("event_id") % 50).alias("j")).agg(F.round(F.avg("value") * 8).cast("long").alias("v"))


def over(how: str, axis: str, reach: int, source: str) -> str:
    other = "j" if axis == "i" else "i"
    return f"SELECT i, j, {how}(v) OVER (PARTITION BY {other} ORDER BY {axis} RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS v FROM {source}"


def raster_cte(*steps: tuple[str, str]) -> str:
    out, name = "", "r"
    for k, (how, axis) in enumerate(steps):
        out += f", s{k} AS ({over(how, axis, 2, name)})"
        name = f"s{k}"
    return out + f" SELECT i, j, v FROM {name}"


@query(f"{WITH}, r AS ({BURN})" + raster_cte(("min", "i"), ("min", "j"), ("max", "i"), ("max", "j")))
def grey_opening(spark, sf_dir):
    return R.opened(burned(spark, sf_dir), 2)


@query(f"{WITH}, r AS ({BURN})" + raster_cte(("sum", "i"), ("sum", "j")).replace("SELECT i, j, v FROM s1", "SELECT i, j, round(v / 25.0, 6)::DOUBLE AS v FROM s1"))
def box_blur(spark, sf_dir):
    return R.box_mean(burned(spark, sf_dir), 2).withColumn("v", F.round("v", 6))


@query(f"{WITH}, r AS ({BURN}), b2 AS (SELECT i, j, arg_max(h, id) AS v FROM (SELECT id, h, i, unnest({CENTRES.format('y')}) AS j FROM (SELECT *, unnest({CENTRES.format('x')}) AS i FROM b)) GROUP BY 1, 2) SELECT coalesce(r.i, b2.i) AS i, coalesce(r.j, b2.j) AS j, coalesce(r.v, b2.v) AS v FROM r FULL JOIN b2 ON r.i = b2.i AND r.j = b2.j")
def mosaic_precedence(spark, sf_dir):
    return R.mosaic([burned(spark, sf_dir), R.burned(outlines(spark, sf_dir), 10, "h", "id")])


@query(f"""{WITH}, r AS ({BURN}), k AS (SELECT id, i, unnest(generate_series(CAST(ceil(y0 / 10.0 - 0.5) AS BIGINT), greatest(CAST(ceil(y0 / 10.0 - 0.5) AS BIGINT), CAST(ceil(y1 / 10.0 - 0.5) AS BIGINT) - 1))) AS j
FROM (SELECT *, unnest(generate_series(CAST(ceil(x0 / 10.0 - 0.5) AS BIGINT), greatest(CAST(ceil(x0 / 10.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 10.0 - 0.5) AS BIGINT) - 1))) AS i FROM b))
SELECT id, median(v) AS median, count(*) AS n, min(v) AS low FROM k JOIN r USING (i, j) GROUP BY 1""")
def zonal_median(spark, sf_dir):
    return R.zonal(burned(spark, sf_dir), outlines(spark, sf_dir), 10, F.median("v").alias("median"), F.count("*").alias("n"), F.min("v").alias("low"))


@query(f"{WITH}, r AS ({BURN}) SELECT CAST(floor(i / 4.0) AS BIGINT) AS i, CAST(floor(j / 4.0) AS BIGINT) AS j, count(*) / 16.0::DOUBLE AS v FROM r GROUP BY 1, 2")
def cover_share(spark, sf_dir):
    return R.shares(burned(spark, sf_dir).withColumn("v", F.lit(1)), 4)


@query(f"""{WITH}, r AS ({BURN}), q AS (SELECT id, floor(x / 10.0 - 0.5) AS fi, floor(y / 10.0 - 0.5) AS fj, x / 10.0 - 0.5 AS u, y / 10.0 - 0.5 AS w FROM p),
c AS (SELECT q.id, sum(v * CASE WHEN da = 1 THEN u - fi ELSE 1 - u + fi END * CASE WHEN db = 1 THEN w - fj ELSE 1 - w + fj END) AS v, count(*) AS n FROM q, (VALUES (0), (1)) t(da), (VALUES (0), (1)) s(db) JOIN r ON r.i = q.fi + da AND r.j = q.fj + db GROUP BY 1)
SELECT p.id, round(CASE WHEN n = 4 THEN v END, 6)::DOUBLE AS v FROM p LEFT JOIN c ON c.id = p.id""")
def bilinear_sample(spark, sf_dir):
    return R.bilinear(burned(spark, sf_dir), landmarks(spark, sf_dir).select("id", "x", "y"), 10).withColumn("v", F.round("v", 6))


# two triangles a square of 50, heights by a rule
TIN = f"""{WITH}, q AS (SELECT id, x, y, (x // 50) * 50 AS ax, (y // 50) * 50 AS ay FROM p), f AS (SELECT *, (x - ax) / 50.0 AS u, (y - ay) / 50.0 AS w, (ax * 7 + ay * 3) % 97 AS h00, ((ax + 50) * 7 + ay * 3) % 97 AS h10, (ax * 7 + (ay + 50) * 3) % 97 AS h01, ((ax + 50) * 7 + (ay + 50) * 3) % 97 AS h11 FROM q)
SELECT id, round(CASE WHEN u + w <= 1 THEN h00 + u * (h10 - h00) + w * (h01 - h00) ELSE h11 + (1 - u) * (h01 - h11) + (1 - w) * (h10 - h11) END, 6)::DOUBLE AS v FROM f"""


@query(TIN)
def tin_height(spark, sf_dir):
    return heights(spark, landmarks(spark, sf_dir))


def heights(spark, points):
    squares = spark.range(400).selectExpr("id div 20 * 50 as x", "id % 20 * 50 as y", "id as q")
    h = lambda a, b: f"cast((({a}) * 7 + ({b}) * 3) % 97 as double)"
    low = squares.selectExpr("q * 2 as t", "x as ax", "y as ay", f"{h('x', 'y')} as av", "x + 50 as bx", "y as by", f"{h('x + 50', 'y')} as bv", "x as cx", "y + 50 as cy", f"{h('x', 'y + 50')} as cv")
    high = squares.selectExpr("q * 2 + 1 as t", "x + 50 as ax", "y + 50 as ay", f"{h('x + 50', 'y + 50')} as av", "x as bx", "y + 50 as by", f"{h('x', 'y + 50')} as bv", "x + 50 as cx", "y as cy", f"{h('x + 50', 'y')} as cv")
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return R.barycentric(points, low.unionAll(high), 50).withColumn("v", F.round("v", 6))


# --- networks ---------------------------------------------------------------------------------------------------------

EDGES = "SELECT p_partkey AS a, p_partkey + 1 + p_partkey % 3 AS b, 1.0::DOUBLE + p_size AS length FROM part"


def edges(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey as a", "p_partkey + 1 + p_partkey % 3 as b", "1.0D + p_size as length")


def nodes(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select(F.col("a").alias("id")).union(e.select("b")).distinct()


NODES = f"e AS ({EDGES}), d AS (SELECT a, b, length FROM e UNION ALL SELECT b, a, length FROM e), n AS (SELECT DISTINCT a AS id FROM d)"


@query(f"""WITH RECURSIVE {NODES}, walk AS (SELECT id, id AS component FROM n UNION SELECT d.b, walk.component FROM walk JOIN d ON d.a = walk.id WHERE walk.component < d.b) SELECT id, min(component) AS component FROM walk GROUP BY 1""")
def connected_components(spark, sf_dir):
    return N.component_ids(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {NODES}, s AS (SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 6 + id % 4 END::DOUBLE AS h FROM n),
walk AS (SELECT id, h, 0 AS k FROM s UNION SELECT d.b, round(walk.h + 0.06 * d.length, 9), k + 1 FROM walk JOIN d ON d.a = walk.id JOIN s ON s.id = d.b WHERE walk.h + 0.06 * d.length < s.h AND k < 40)
SELECT id, round(min(h), 6) AS h FROM walk GROUP BY 1""")
def deck_relaxation(spark, sf_dir):
    start = nodes(spark, sf_dir).selectExpr("id", "cast(if(id % 5 = 0, 0, 6 + id % 4) as double) as h")
    return N.lower_envelope(start, edges(spark, sf_dir), 0.06).withColumn("h", F.round("h", 6))


@query(f"WITH {NODES} SELECT a AS id, count(*) AS degree FROM d GROUP BY 1")
def junction_degree(spark, sf_dir):
    return N.degrees(edges(spark, sf_dir))


HARMONIC = "SELECT n.id, CASE WHEN n.id % 10 = 0 THEN CAST(n.id AS DOUBLE) ELSE coalesce(m, v) END AS v FROM {0} n LEFT JOIN (SELECT d.b AS id, sum(v / length) / sum(1 / length) AS m FROM {0} JOIN d ON d.a = {0}.id GROUP BY 1) x ON x.id = n.id"


@query(f"WITH {NODES}, h0 AS (SELECT id, CASE WHEN id % 10 = 0 THEN CAST(id AS DOUBLE) ELSE 0 END AS v FROM n), h1 AS ({HARMONIC.format('h0')}), h2 AS ({HARMONIC.format('h1')}), h3 AS ({HARMONIC.format('h2')}) SELECT id, round(v, 6) AS v FROM h3")
def harmonic_levels(spark, sf_dir):
    all_nodes = nodes(spark, sf_dir)
    pinned = all_nodes.where("id % 10 = 0").selectExpr("id", "cast(id as double) as v")
    return N.harmonic(pinned, all_nodes, edges(spark, sf_dir), 3).withColumn("v", F.round("v", 6))


# the whole solve, with the pull to the ground; the sweeps above are the first three of the way there, from 0 and without it
@query()
def grade_line(spark, sf_dir):
    at = nodes(spark, sf_dir).selectExpr("id", "cast(id + id % 10 as double) as ground", "id % 10 = 0 as pinned")
    return N.grade_line(at, edges(spark, sf_dir)).withColumn("v", F.round("v", 6))


# --- placement --------------------------------------------------------------------------------------------------------


@query(f"""{WITH}, g AS (SELECT id, u, unnest(generate_series(y0, y1 - 1, 4)) AS w FROM (SELECT *, unnest(generate_series(x0, x1 - 1, 4)) AS u FROM b)),
s AS (SELECT *, (u * 7919 + w * 104729) % 1000 AS k FROM g) SELECT id, u + k % 4 AS x, w + k // 4 % 4 AS y FROM s WHERE k < 400""")
def jitter_scatter(spark, sf_dir):
    g = outlines(spark, sf_dir).select("id", F.explode(F.expr("sequence(x0, x1 - 1, 4)")).alias("u"), "y0", "y1").select("id", "u", F.explode(F.expr("sequence(y0, y1 - 1, 4)")).alias("w"))
    return g.withColumn("k", F.expr("(u * 7919 + w * 104729) % 1000")).where("k < 400").selectExpr("id", "u + k % 4 as x", "w + k div 4 % 4 as y")


@query(f"""{WITH}, g AS (SELECT id, t, unnest([y0 - 2, y1 + 2]) AS y FROM (SELECT *, unnest(generate_series(x0, x1, 8)) AS t FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY t // 4, (y + 4) // 4 ORDER BY id, t, y) AS k FROM g) SELECT id, t AS x, y, 'species' || (id * 31 % 5) AS species FROM r WHERE k = 1""")
def street_points(spark, sf_dir):
    from cityloom.operators.spatial import distinct_first

    g = outlines(spark, sf_dir).select("id", F.explode(F.expr("sequence(x0, x1, 8)")).alias("x"), F.array(F.col("y0") - 2, F.col("y1") + 2).alias("ys")).select("id", "x", F.explode("ys").alias("y"))
    cells = g.withColumns({"_i": F.expr("x div 4"), "_j": F.expr("(y + 4) div 4")})
    return distinct_first(cells, ["_i", "_j"], "id", "x", "y").select("id", "x", "y", F.concat(F.lit("species"), F.col("id") * 31 % 5).alias("species"))


@query(f"{WITH} SELECT id, CAST((x1 - x0) // 3 * ((y1 - y0) // 5) AS BIGINT) AS bays, count(*) FILTER (k * 2654435761 % 1000 < 700) AS parked FROM (SELECT *, unnest(generate_series(1, (x1 - x0) // 3 * ((y1 - y0) // 5))) + id * 100 AS k FROM b) GROUP BY 1, 2")
def parking_lots(spark, sf_dir):
    bays = outlines(spark, sf_dir).withColumn("bays", F.expr("((x1 - x0) div 3) * ((y1 - y0) div 5)")).where("bays > 0")
    each = bays.select("id", "bays", F.explode(F.expr("sequence(id * 100 + 1, id * 100 + bays)")).alias("k"))
    return each.groupBy("id", "bays").agg(F.count(F.when(id_share(F.col("k")) < 0.7, 1)).alias("parked"))


# --- packaging --------------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT CAST(floor((x0 + x1) / 2.0 / 125) AS BIGINT) AS tx, CAST(floor((y0 + y1) / 2.0 / 125) AS BIGINT) AS ty, count(*) AS n FROM a GROUP BY 1, 2")
def tile_keys(spark, sf_dir):
    a = footprints(spark, sf_dir)
    return a.groupBy(*P.tile((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, 125)).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, CAST(coalesce(sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM orders")
def block_offsets(spark, sf_dir):
    parts = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").withColumn("n", F.col("o_orderkey") % 1000)
    return P.block_offsets(parts, "o_custkey", ["o_orderkey"], "n").drop("n")


@query("WITH i AS (SELECT o_custkey AS name, max(o_orderkey) AS changed FROM orders GROUP BY 1) SELECT name, changed - c_custkey * 5 AS by FROM customer JOIN i ON c_custkey = name WHERE changed - c_custkey * 5 > 1")
def stale_layers(spark, sf_dir):
    made = read(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey as name", "c_custkey * 5 as made")
    return P.stale(made, read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").selectExpr("o_custkey as name", "o_orderkey as changed"))


@query("""WITH x AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 10 > 0), y AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice + 1e-9 END AS price FROM part WHERE p_partkey % 11 > 0)
SELECT coalesce(x.id, y.id) AS id, CASE WHEN y.id IS NULL THEN 'extra' WHEN x.id IS NULL THEN 'missing' ELSE 'changed' END AS state FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.name IS DISTINCT FROM y.name OR abs(x.price - y.price) > 1e-6""")
def verify_diff(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    x = part.where("p_partkey % 10 > 0").selectExpr("p_partkey as id", "p_name as name", "p_retailprice as price")
    y = part.where("p_partkey % 11 > 0").selectExpr("p_partkey as id", "p_name as name", "if(p_partkey % 7 = 0, p_retailprice + 1, p_retailprice + 1e-9D) as price")
    return P.differences(x, y, "id")
