"""Queries of the spatial joins and set operations on boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.operators import dense as D
from cityloom.operators import spatial as S
from cityloom.plans.entities import WITH, footprints, landmarks, outlines, read

INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
A_AREA, B_AREA = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
D2 = "(greatest(0, b.x0 - a.x1, a.x0 - b.x1) ** 2 + greatest(0, b.y0 - a.y1, a.y0 - b.y1) ** 2)"
HELD = "b.x0 <= p.x AND p.x <= b.x1 AND b.y0 <= p.y AND p.y <= b.y1"
#: Boxes of one table against others of the same table.
SELF = WITH.replace(", b AS (", ", b AS (SELECT * FROM a), c AS (", 1)
LONG = "CAST({} AS BIGINT)".format

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""{WITH}, j AS (SELECT a.id AS a_id, b.id AS b_id, {INTER} AS i, {A_AREA} AS s, {B_AREA} AS t FROM a JOIN b ON {MEET}),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY i DESC, b_id) AS n FROM j)
SELECT a_id, b_id, {LONG('i')} AS inter, round(i / (s + t - i), 9) AS iou FROM r WHERE n = 1""")
def best_match_iou(spark, sf_dir):
    out = S.best_match(footprints(spark, sf_dir), outlines(spark, sf_dir))
    return out.select("a_id", "b_id", "inter", F.round("iou", 9).alias("iou"))


@query(f"{WITH} SELECT a.id AS a_id, count(*) AS n, {LONG('sum(b.h)')} AS total_h FROM a JOIN b ON {TOUCH} GROUP BY 1")
def spatial_intersects(spark, sf_dir):
    return D.touching(footprints(spark, sf_dir), outlines(spark, sf_dir)).toDF("a_id", "n", "total_h")


@query(f"{WITH} SELECT p.id AS p_id, min(b.id) AS b_id FROM p LEFT JOIN b ON {HELD} GROUP BY 1")
def spatial_within(spark, sf_dir):
    return S.first_container(landmarks(spark, sf_dir), outlines(spark, sf_dir))


@query(f"""{WITH}, r AS (SELECT p.id AS p_id, b.id AS b_id, {B_AREA} AS area, row_number() OVER (PARTITION BY p.id ORDER BY {B_AREA}, b.id) AS n
FROM p JOIN b ON {HELD}) SELECT p_id, b_id, area FROM r WHERE n = 1""")
def smallest_container(spark, sf_dir):
    return S.smallest_container(landmarks(spark, sf_dir), outlines(spark, sf_dir))


@query(f"""{WITH.replace('p AS (', 'q AS (')}, p AS (SELECT id, x AS x0, x AS x1, y AS y0, y AS y1 FROM q),
r AS (SELECT a.id AS a_id, b.id AS b_id, {D2} AS d2 FROM p AS a JOIN b ON {D2} <= 900),
s AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS n FROM r) SELECT a_id, b_id, {LONG('d2')} AS d2 FROM s WHERE n = 1""")
def nearest_within(spark, sf_dir):
    points = S.as_boxes(landmarks(spark, sf_dir)).select("id", "x0", "x1", "y0", "y1")
    return S.nearest(points, outlines(spark, sf_dir), 30)


@query(f"""{WITH}, r AS (SELECT p.id AS a_id, q.id AS b_id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS d2 FROM p JOIN p AS q ON p.id <> q.id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 10000),
s AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS n FROM r) SELECT a_id, b_id, {LONG('d2')} AS d2 FROM s WHERE n = 1""")
def nearest_other_point(spark, sf_dir):
    return S.nearest_other(landmarks(spark, sf_dir), 100)


@query(f"""{SELF} SELECT a.id AS a_id, b.id AS b_id, {LONG(INTER)} AS inter FROM a JOIN b ON a.id < b.id AND {MEET}
WHERE {INTER} <> {A_AREA} AND {INTER} <> {B_AREA}""")
def overlap_pairs(spark, sf_dir):
    return S.overlapping(footprints(spark, sf_dir))


@query(f"{SELF} SELECT a.id AS a_id, b.id AS b_id, abs(a.h - b.h) AS jump FROM a JOIN b ON a.id < b.id AND {TOUCH} AND NOT ({MEET}) WHERE abs(a.h - b.h) > 10")
def touching_jumps(spark, sf_dir):
    pairs = S.self_pairs(footprints(spark, sf_dir), interior=False).where((S.shared("x") == 0) | (S.shared("y") == 0))
    return pairs.select("a_id", "b_id", F.abs(F.col("a_h") - F.col("b_h")).alias("jump")).where("jump > 10")


@query(f"{SELF} SELECT a.id, max(b.h) AS base FROM a JOIN b ON a.id <> b.id AND a.h > b.h AND {MEET} WHERE {INTER} >= 0.9 * {A_AREA} GROUP BY 1")
def nested_base(spark, sf_dir):
    return S.raised_base(footprints(spark, sf_dir))


@query(f"{WITH}, c AS (SELECT a.id FROM a JOIN b ON {MEET} GROUP BY a.id HAVING sum({INTER}) >= 0.5 * any_value({A_AREA})) SELECT id, h, src FROM a WHERE id NOT IN (SELECT id FROM c)")
def anti_by_share(spark, sf_dir):
    return S.without_covered(footprints(spark, sf_dir), outlines(spark, sf_dir), 0.5).select("id", "h", "src")


@query(f"""{SELF}, holders AS (SELECT a.id FROM a JOIN b ON a.id <> b.id AND {MEET} WHERE {INTER} >= 0.8 * {B_AREA} GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM holders)),
gone AS (SELECT CASE WHEN {A_AREA} < {B_AREA} THEN a.id ELSE b.id END AS id FROM k AS a JOIN k AS b ON a.id < b.id AND {MEET} WHERE {INTER} > 0.5 * least({A_AREA}, {B_AREA}))
SELECT id, x0, y0 FROM k WHERE id NOT IN (SELECT id FROM gone)""")
def container_drop(spark, sf_dir):
    return S.without_containers(footprints(spark, sf_dir)).select("id", "x0", "y0")


@query(f"""{SELF}, gone AS (SELECT CASE WHEN {A_AREA} < {B_AREA} THEN a.id ELSE b.id END AS id FROM a JOIN b ON a.id < b.id AND {MEET}
WHERE {INTER} >= 0.9 * least({A_AREA}, {B_AREA})) SELECT id, h FROM a WHERE id NOT IN (SELECT id FROM gone)""")
def dedupe90(spark, sf_dir):
    return S.without_twins(footprints(spark, sf_dir), 0.9).select("id", "h")


@query(f"""{SELF}, s AS (SELECT *, h % 7 AS lo, CASE WHEN src = 'osm' THEN 1000000 ELSE 0 END + h AS rank FROM a),
q AS (SELECT a.id AS i, b.id AS j, a.rank AS ra, b.rank AS rb, {INTER} AS inter FROM s AS a JOIN s AS b ON a.id < b.id AND {MEET} AND least(a.h, b.h) - greatest(a.lo, b.lo) > 1
WHERE {INTER} >= greatest(5, 0.1 * least({A_AREA}, {B_AREA})))
SELECT CASE WHEN ra < rb THEN i ELSE j END AS loser, CASE WHEN ra < rb THEN j ELSE i END AS winner, {LONG('inter')} AS inter FROM q""")
def volume_overlap(spark, sf_dir):
    return S.volume_losers(footprints(spark, sf_dir).withColumn("lo", F.col("h") % 7), "osm")


@query(f"{WITH} SELECT a.id AS a_id, b.id AS b_id, {LONG(INTER)} AS inter FROM a JOIN b ON {MEET} WHERE {INTER} >= 0.5 * {B_AREA}")
def containment_pairs(spark, sf_dir):
    return S.inside(footprints(spark, sf_dir), outlines(spark, sf_dir), 0.5)


@query(f"{SELF} SELECT a.id, count(*) AS neighbours FROM a JOIN b ON a.id <> b.id AND {D2} <= 9 AND b.h >= a.h - 1 GROUP BY 1")
def party_walls(spark, sf_dir):
    return S.party_walls(footprints(spark, sf_dir), 3, 1)


# every unit square of a box, so that what several cover counts once
SQUARES = """, s AS (SELECT id, h, unnest(generate_series(x0, x1 - 1)) AS sx, y0, y1 FROM a), sq AS (SELECT id, h, sx, unnest(generate_series(y0, y1 - 1)) AS sy FROM s),
t AS (SELECT id, h, unnest(generate_series(x0, x1 - 1)) AS sx, y0, y1 FROM b), tq AS (SELECT id, h, sx, unnest(generate_series(y0, y1 - 1)) AS sy FROM t)"""


@query(f"""{WITH}{SQUARES}, u AS (SELECT sq.id, count(DISTINCT (sq.sx, sq.sy)) AS m, count(DISTINCT tq.id) AS pieces FROM sq JOIN tq ON sq.sx = tq.sx AND sq.sy = tq.sy GROUP BY 1)
SELECT u.id, pieces, CAST(m AS DOUBLE) AS covered, round(m / ({A_AREA}), 9) AS share FROM u JOIN a ON a.id = u.id""")
def road_clearance(spark, sf_dir):
    out = S.covered_area(footprints(spark, sf_dir), outlines(spark, sf_dir))
    return out.withColumn("share", F.round("share", 9))


@query(f"""{SELF}{SQUARES}, u AS (SELECT sq.id, count(DISTINCT (sq.sx, sq.sy)) AS m, count(DISTINCT tq.id) AS hosts FROM sq JOIN tq ON sq.sx = tq.sx AND sq.sy = tq.sy AND sq.id <> tq.id AND tq.h >= sq.h - 25 AND tq.h < sq.h GROUP BY 1)
SELECT u.id, hosts FROM u JOIN a ON a.id = u.id WHERE hosts >= 2 AND m >= 0.3 * ({A_AREA})""")
def deck_rule(spark, sf_dir):
    return D.decks(footprints(spark, sf_dir))


@query(f"""WITH RECURSIVE {WITH.removeprefix('WITH ')}, c AS (SELECT p.id AS p, b.id AS b, abs(p.h - b.h) * 1000 + least(999, (p.x - b.x0) ** 2 + (p.y - b.y0) ** 2) AS score FROM p JOIN b ON {HELD}),
o AS (SELECT *, row_number() OVER (ORDER BY score, p, b) AS n FROM c),
g AS (SELECT 0 AS n, [-1]::BIGINT[] AS ps, [-1]::BIGINT[] AS bs, 0::BIGINT AS p, 0::BIGINT AS b, 0::DOUBLE AS score, false AS ok
UNION ALL SELECT o.n, CASE WHEN f THEN list_append(ps, o.p) ELSE ps END, CASE WHEN f THEN list_append(bs, o.b) ELSE bs END, o.p, o.b, o.score, f
FROM g JOIN o ON o.n = g.n + 1, LATERAL (SELECT NOT list_contains(g.ps, o.p) AND NOT list_contains(g.bs, o.b) AS f))
SELECT p, b, {LONG('score')} AS score FROM g WHERE ok""")
def greedy_assign(spark, sf_dir):
    score = F.abs(F.col("p_h") - F.col("b_h")) * 1000 + F.least(F.lit(999), F.expr("(p_x - b_x0) * (p_x - b_x0) + (p_y - b_y0) * (p_y - b_y0)"))
    return S.greedy_by_kind(landmarks(spark, sf_dir).select("id", "x", "y", "h"), outlines(spark, sf_dir), score)


@query(f"""{WITH}, j AS (SELECT a.id AS a_id, b.id AS b_id, b.use, {INTER} AS i, {A_AREA} AS s, {B_AREA} AS t FROM a JOIN b ON {MEET}),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY i DESC, b_id) AS n FROM j),
best AS (SELECT * FROM r WHERE n = 1 AND (i >= 0.5 * (s + t - i) OR i >= 0.5 * s))
SELECT a.id, best.use, CASE WHEN i IS NULL THEN NULL WHEN i >= 0.5 * (s + t - i) THEN 'same' ELSE 'inside' END AS how FROM a LEFT JOIN best ON a.id = best.a_id""")
def attach_attributes(spark, sf_dir):
    a, b = footprints(spark, sf_dir), outlines(spark, sf_dir)
    how = F.when(F.col("iou") >= 0.5, "same").when(F.col("inter") >= 0.5 * F.col("own"), "inside")
    m = S.best_match(a, b).select(F.col("a_id").alias("id"), "b_id", how.alias("how")).where("how is not null")
    m = m.join(b.select(F.col("id").alias("b_id"), "use"), "b_id")
    return a.select("id").join(m, "id", "left").select("id", "use", "how")


@query(f"""{WITH}, j AS (SELECT a.id AS a_id, b.id AS b_id, b.use, {INTER} AS i, {A_AREA} AS s FROM a JOIN b ON {MEET} WHERE a.src <> 'osm'),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY i DESC, b_id) AS n FROM j)
SELECT a.id, coalesce(CASE WHEN a.n % 3 = 0 THEN a.kind END, r.use) AS kind FROM a LEFT JOIN r ON r.a_id = a.id AND r.n = 1 AND i >= 0.6 * s""")
def lend_fields(spark, sf_dir):
    a, b = footprints(spark, sf_dir), outlines(spark, sf_dir)
    other = a.where("src <> 'osm'")
    lent = S.best_match(other, b).where("inter >= 0.6 * own")
    lent = lent.join(b.select(F.col("id").alias("b_id"), "use"), "b_id").select(F.col("a_id").alias("id"), "use")
    return a.join(lent, "id", "left").select("id", F.coalesce(F.when(F.col("n") % 3 == 0, F.col("kind")), "use").alias("kind"))


@query(f"""{SELF}, q AS (SELECT a.id, a.h, b.h AS other FROM a JOIN b ON a.id <> b.id AND {TOUCH} AND a.n % 2 <> b.n % 2)
SELECT id, {LONG('min(other)')} AS limit_h FROM q WHERE other < h GROUP BY 1""")
def twin_limits(spark, sf_dir):
    a = footprints(spark, sf_dir)
    pairs = S.box_pairs(a, a, interior=False).where("a_id <> b_id and a_n % 2 <> b_n % 2 and b_h < a_h")
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.min("b_h").alias("limit_h"))


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM orders)
SELECT c_custkey, o_orderpriority FROM customer LEFT JOIN r ON CAST(c_custkey AS VARCHAR) = k AND n = 1""")
def attribute_join(spark, sf_dir):
    right = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").withColumn("key", F.concat(F.lit(" "), F.col("o_custkey").cast("double").cast("string")))
    return S.attribute_join(read(spark, sf_dir, "customer", "c_custkey"), "c_custkey", right, "key", ["o_orderpriority"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, sf_dir):
    wanted = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query(f"""{WITH}, j AS (SELECT a.id AS part, b.id AS host, {INTER} AS i, {A_AREA} AS s, {B_AREA} AS t FROM a JOIN b ON {MEET}),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY i DESC, host) AS n FROM j),
k AS (SELECT * FROM r WHERE n = 1 AND i >= 0.5 * s AND s <= 1.5 * t)
SELECT host, count(*) AS parts, {LONG('sum(least(s, t))')} AS area FROM k GROUP BY 1 HAVING sum(least(s, t)) >= 0.25 * any_value(t)""")
def parts_to_host(spark, sf_dir):
    a, b = footprints(spark, sf_dir), outlines(spark, sf_dir)
    m = S.best_match(a, b).withColumnsRenamed({"own": "s", "other": "t"})
    kept = m.where("inter >= 0.5 * s and s <= 1.5 * t")
    out = kept.groupBy(F.col("b_id").alias("host")).agg(F.count("*").alias("parts"), F.sum(F.least("s", "t")).alias("area"), F.first("t").alias("t"))
    return out.where("area >= 0.25 * t").select("host", "parts", "area")


@query(f"""{WITH}{SQUARES} SELECT count(DISTINCT (sx, sy)) AS squares FROM (SELECT sx, sy, sx // 200 AS tile FROM tq) GROUP BY tile""")
def union_by_tile(spark, sf_dir):
    b = outlines(spark, sf_dir).withColumn("tile", F.explode(F.sequence(F.floor(F.col("x0") / 200), F.floor((F.col("x1") - 1) / 200))))
    clipped = b.select("tile", F.greatest("x0", F.col("tile") * 200).alias("x0"), "y0", F.least("x1", F.col("tile") * 200 + 200).alias("x1"), "y1")
    return clipped.groupBy("tile").agg(S.union_area("x0", "y0", "x1", "y1").cast("bigint").alias("squares")).select("squares")


@query(f"""{WITH}{SQUARES}, left_over AS (SELECT sq.id, count(DISTINCT (sq.sx, sq.sy)) AS m FROM sq SEMI JOIN tq ON sq.sx = tq.sx AND sq.sy = tq.sy GROUP BY 1)
SELECT a.id, CAST(({A_AREA}) - coalesce(m, 0) AS DOUBLE) AS area FROM a LEFT JOIN left_over l ON a.id = l.id""")
def difference_area(spark, sf_dir):
    return D.uncovered_area(footprints(spark, sf_dir), outlines(spark, sf_dir))
