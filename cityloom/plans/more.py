"""Queries of the remaining filters, repairs, fields and encoders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cityloom.functions.geometry import utm
from cityloom.operators import dense as D
from cityloom.operators import network as N
from cityloom.operators import raster as R
from cityloom.operators import spatial as S
from cityloom.operators.lineage import cut
from cityloom.plans.entities import WITH, footprints, landmarks, outlines, read
from cityloom.plans.layers import BURN, EDGES, burned, edges
from cityloom.sources.sinks import decoded_tiles, point_tiles

QUERIES, SQL = {}, {}
MEETS = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
TOUCHES = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "(a.x1 - a.x0) * (a.y1 - a.y0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 5) AND p_size NOT IN (1, 2, 3)")
def exclude_lists(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    listed = p.where("p_partkey < 5").select("p_brand")
    return p.join(listed, "p_brand", "left_anti").where(~F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@query(f"""{WITH}, c AS (SELECT a.id FROM a JOIN b ON {MEETS} AND b.use = 'BUILDING' GROUP BY a.id HAVING sum({INTER}) >= 0.5 * any_value({AREA}))
SELECT id FROM a WHERE {AREA} >= 60 AND h >= 6 AND kind <> 'Brand#11' AND id NOT IN (SELECT id FROM c)""")
def fill_filter(spark, sf_dir):
    a = footprints(spark, sf_dir).where((S.area() >= 60) & (F.col("h") >= 6) & (F.col("kind") != "Brand#11"))
    return S.without_covered(a, outlines(spark, sf_dir).where("use = 'BUILDING'"), 0.5).select("id")


@query(f"""{WITH}, c AS (SELECT a.id FROM a JOIN b ON {MEETS} GROUP BY a.id HAVING sum({INTER}) >= 0.5 * any_value({AREA})) SELECT id FROM a WHERE n % 4 > 0 OR kind = 'Brand#12' OR id IN (SELECT id FROM c)""")
def surface_rescue(spark, sf_dir):
    a, below = footprints(spark, sf_dir), F.col("n") % 4 == 0
    covered = S.box_pairs(a.where(below), outlines(spark, sf_dir)).groupBy(F.col("a_id").alias("id")).agg(F.sum(S.overlap()).alias("i"), F.first(S.area("a_")).alias("s")).where("i >= 0.5 * s").select("id")
    kept = a.where(~below | (F.col("kind") == "Brand#12")).select("id")
    return kept.union(a.where(below).join(covered, "id", "left_semi").select("id")).distinct()


@query("SELECT p_partkey AS id, p_partkey % 5 IN (1, 2) OR p_size % 4 = 0 AS hidden, p_partkey % 3 = 0 AND p_partkey % 5 <> 4 AS lot FROM part")
def tag_predicates(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    tags = F.map_filter(F.create_map(
        F.lit("tunnel"), F.when(F.col("p_partkey") % 5 == 1, "culvert").otherwise("no"), F.lit("covered"), F.when(F.col("p_partkey") % 5 == 2, "yes"),
        F.lit("layer"), F.when(F.col("p_size") % 4 == 0, "-1").otherwise("0"), F.lit("amenity"), F.when(F.col("p_partkey") % 3 == 0, "parking"),
        F.lit("parking"), F.when(F.col("p_partkey") % 5 == 4, "underground").otherwise("surface"),
    ), lambda k, v: v.isNotNull())
    t = p.select(F.col("p_partkey").alias("id"), tags.alias("t"))
    says = lambda k: F.coalesce(F.col("t")[k], F.lit("no")) != "no"
    hidden = says("tunnel") | says("covered") | (F.coalesce(F.col("t")["layer"].try_cast("int"), F.lit(0)) < 0)
    lot = (F.coalesce(F.col("t")["amenity"], F.lit("")) == "parking") & F.coalesce(F.col("t")["parking"], F.lit("surface")).isin("surface", "street_side", "lane")
    return t.select("id", hidden.alias("hidden"), lot.alias("lot"))


@query("SELECT c_mktsegment AS was, CASE c_mktsegment WHEN 'BUILDING' THEN 'office' WHEN 'MACHINERY' THEN 'industrial' ELSE lower(c_mktsegment) END AS kind, count(*) AS n FROM customer GROUP BY 1, 2")
def remap_kinds(spark, sf_dir):
    known = F.create_map(F.lit("BUILDING"), F.lit("office"), F.lit("MACHINERY"), F.lit("industrial"))
    c = read(spark, sf_dir, "customer", "c_mktsegment")
    return c.select(F.col("c_mktsegment").alias("was"), F.coalesce(known[F.col("c_mktsegment")], F.lower("c_mktsegment")).alias("kind")).groupBy("was", "kind").agg(F.count("*").alias("n"))


@query(f"""{WITH}, t AS (SELECT a.id, b.h FROM a JOIN a AS b ON a.id <> b.id AND {TOUCHES} AND abs(a.h - b.h) <= 4 AND (b.x1 - b.x0) * (b.y1 - b.y0) > 1.2 * {AREA}),
m AS (SELECT a.id, median(b.h) AS m FROM a JOIN a AS b ON a.id <> b.id AND {TOUCHES} AND abs(a.h - b.h) > 4 GROUP BY 1)
SELECT id, m AS h FROM m WHERE id IN (SELECT id FROM t) AND m < (SELECT h FROM a WHERE a.id = m.id)""")
def copied_heights(spark, sf_dir):
    return D.copied(footprints(spark, sf_dir))


@query(f"""{WITH}, o AS (SELECT a.id, max(b.h) AS base, CAST(max({INTER}) AS BIGINT) AS most FROM a JOIN a AS b ON a.id <> b.id AND a.src <> b.src AND {MEETS} WHERE {INTER} >= 5 AND {INTER} >= 0.05 * {AREA} AND b.h < a.h - 3 GROUP BY 1) SELECT * FROM o""")
def cantilevers(spark, sf_dir):
    a = footprints(spark, sf_dir)
    key, kinds = [*D.BOX, "src", "h"], D.outer_boxes(D.proper(a), "src", "h")  # the larger of two of a kind has the greater overlap
    over = S.box_pairs(D.proper(a).select(*key).distinct(), kinds).where("a_src <> b_src and b_h < a_h - 3").withColumn("i", S.overlap()).where((F.col("i") >= 5) & (F.col("i") >= 0.05 * S.area("a_")))
    best = over.groupBy(*[F.col(f"a_{c}").alias(c) for c in key]).agg(F.max("b_h").alias("base"), F.max("i").alias("most"))
    return a.join(best, key).select("id", "base", "most")


@query(f"""{WITH}, w AS (SELECT p.id, p.x, p.y, b.x0, b.y0, b.x1, b.y1, row_number() OVER (PARTITION BY p.id ORDER BY b.id) AS k FROM p JOIN b ON b.x0 < p.x AND p.x < b.x1 AND b.y0 < p.y AND p.y < b.y1),
d AS (SELECT *, least(x - x0, x1 - x, y - y0, y1 - y) AS m FROM w WHERE k = 1)
SELECT id, CASE WHEN x - x0 = m THEN x0 WHEN x1 - x = m THEN x1 ELSE x END AS x, CASE WHEN x - x0 = m OR x1 - x = m THEN y WHEN y - y0 = m THEN y0 ELSE y1 END AS y FROM d""")
def pushed_points(spark, sf_dir):
    held = S.containing(landmarks(spark, sf_dir), outlines(spark, sf_dir)).where("b_x0 < p_x and p_x < b_x1 and b_y0 < p_y and p_y < b_y1")
    one = S.distinct_first(held, ["p_id"], "b_id").withColumn("m", F.expr("least(p_x - b_x0, b_x1 - p_x, p_y - b_y0, b_y1 - p_y)"))
    x = F.expr("case when p_x - b_x0 = m then b_x0 when b_x1 - p_x = m then b_x1 else p_x end")
    y = F.expr("case when p_x - b_x0 = m or b_x1 - p_x = m then p_y when p_y - b_y0 = m then b_y0 else b_y1 end")
    return one.select(F.col("p_id").alias("id"), x.alias("x"), y.alias("y"))


@query(f"""{WITH}, r AS ({BURN}), m AS (SELECT i, j FROM r WHERE v > 55) SELECT r.i, r.j, min((r.i - m.i) ** 2 + (r.j - m.j) ** 2)::BIGINT AS d2 FROM r JOIN m ON abs(r.i - m.i) <= 6 AND abs(r.j - m.j) <= 6 WHERE (r.i - m.i) ** 2 + (r.j - m.j) ** 2 <= 36 GROUP BY 1, 2""")
def distance_to_mask(spark, sf_dir):
    r = burned(spark, sf_dir)
    box = lambda df: df.select(F.struct("i", "j").alias("id"), F.col("i").alias("x0"), F.col("i").alias("x1"), F.col("j").alias("y0"), F.col("j").alias("y1"))
    d2 = S.gap("x") * S.gap("x") + S.gap("y") * S.gap("y")
    near = S.box_pairs(box(r), box(r.where("v > 55")), cell=8, within=6).select("a_id", d2.alias("d2")).where("d2 <= 36")
    return near.groupBy("a_id").agg(F.min("d2").alias("d2")).select("a_id.i", "a_id.j", "d2")


@query(f"""{WITH}, f AS (SELECT CAST(floor((x0 + x1) / 2.0 / 20) AS BIGINT) AS i, CAST(floor((y0 + y1) / 2.0 / 20) AS BIGINT) AS j, sum({AREA} * n) AS v FROM a GROUP BY 1, 2),
s AS (SELECT i, j, sum(v) OVER (PARTITION BY j ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM f), t AS (SELECT i, j, sum(v) OVER (PARTITION BY i ORDER BY j RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25.0 AS v FROM s)
SELECT i, j, round(least(1.2, v / (SELECT quantile_cont(v, 0.92) FROM t)), 6)::DOUBLE AS v FROM t""")
def activity_field(spark, sf_dir):
    a = footprints(spark, sf_dir)
    cells = a.groupBy(F.floor((F.col("x0") + F.col("x1")) / 40).alias("i"), F.floor((F.col("y0") + F.col("y1")) / 40).alias("j")).agg(F.sum(S.area() * F.col("n")).alias("v"))
    mean = R.box_mean(cells, 2)
    top = mean.agg(F.percentile("v", 0.92))
    return mean.select("i", "j", F.round(F.least(F.lit(1.2), F.col("v") / top.scalar()), 6).alias("v"))


@query(f"WITH RECURSIVE {WITH.removeprefix('WITH ')}, g AS (SELECT id, x0 - 3 AS x0, y0 - 3 AS y0, x1 + 3 AS x1, y1 + 3 AS y1 FROM a), e AS (SELECT a.id AS i, b.id AS j FROM g AS a JOIN g AS b ON {TOUCHES}), w AS (SELECT id, id AS c FROM g UNION SELECT e.j, w.c FROM w JOIN e ON e.i = w.id), r AS (SELECT id, min(c) AS c FROM w GROUP BY 1) SELECT c AS id, count(*) AS parts, min(x0) + 3 AS x0, max(x1) - 3 AS x1 FROM r JOIN g USING (id) GROUP BY 1")
def merged_masses(spark, sf_dir):
    return masses(footprints(spark, sf_dir))


def masses(boxes):
    """id (the least), parts, x0, x1 of the boxes that meet when each grows by 3, or are linked by such."""
    g = boxes.select("id", F.col("x0") - 3, F.col("y0") - 3, F.col("x1") + 3, F.col("y1") + 3).toDF("id", "x0", "y0", "x1", "y1")
    whole = F.coalesce(F.col("x0") <= F.col("x1"), F.lit(False)) & F.coalesce(F.col("y0") <= F.col("y1"), F.lit(False))
    # boxes of one corner meet there, and what one of them meets, one of the outer ones meets
    met, alone = g.where(whole), g.where(~whole)
    corner = met.groupBy(*D.CORNER).agg(F.min("id").alias("id"), F.count("*").alias("parts"), F.max("x1").alias("x1"))
    outer = D.outer_boxes(met).join(corner.select(*D.CORNER, "id"), D.CORNER)
    links = cut(S.self_pairs(outer, interior=False).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct())
    label = N.component_ids(corner.select("id"), links, together=True)
    out = corner.join(label, "id").groupBy(F.col("component").alias("id")).agg(F.sum("parts").alias("parts"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    out = out.unionByName(alone.select("id", F.lit(1).cast("long").alias("parts"), "x0", "x1"))
    return out.select("id", "parts", (F.col("x0") + 3).alias("x0"), (F.col("x1") - 3).alias("x1"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), deg AS (SELECT a AS id, count(*) AS n FROM d GROUP BY 1),
l AS (SELECT x.a AS i, y.b AS j FROM d x JOIN d y ON x.b = y.a JOIN deg ON deg.id = x.b AND deg.n = 2 WHERE x.a <> y.b) SELECT i AS a, count(*) AS continues FROM l GROUP BY 1""")
def continuing_ways(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = N.both_ways(e).select("a", "b")
    through = N.degrees(e).where("degree = 2").select(F.col("id").alias("m"))
    left, right = both.select(F.col("a").alias("i"), F.col("b").alias("m")), both.select(F.col("a").alias("m"), F.col("b").alias("j"))
    return left.join(through, "m").join(right, "m").where("i <> j").groupBy(F.col("i").alias("a")).agg(F.count("*").alias("continues"))


@query(f"{WITH} SELECT x / 4.0::DOUBLE AS x, y / 4.0::DOUBLE AS y, CAST(h AS INTEGER) AS code FROM p")
def tile_round_trip(spark, sf_dir):
    p = landmarks(spark, sf_dir).select((F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"), F.col("h").alias("code"))
    return decoded_tiles(point_tiles(p, 100, 0.25), 100, 0.25)


@query(f"""{WITH}, k AS (SELECT a.id AS i, b.id AS j FROM a JOIN a AS b ON a.id <> b.id AND {MEETS} WHERE {INTER} >= 0.5 * {AREA} AND (b.n > a.n OR (b.n = a.n AND b.id < a.id))) SELECT DISTINCT i AS id FROM k""")
def duplicate_carriageways(spark, sf_dir):
    a = footprints(spark, sf_dir)
    rank = F.struct((-F.col("n")).alias("n"), "id")
    pairs = S.box_pairs(D.proper(a).select(*D.BOX).distinct(), D.first_boxes(D.proper(a), rank)).where(S.overlap() >= 0.5 * S.area("a_"))
    best = pairs.groupBy(*[F.col(f"a_{c}").alias(c) for c in D.BOX]).agg(F.min("b_rank").alias("best"))
    return a.join(best, D.BOX).where(F.col("best") < rank).select("id").distinct()


@query(f"{WITH}, c AS (SELECT id, h, n, min(h) OVER (PARTITION BY kind) AS low, CASE WHEN n > 15 THEN 40 END AS listed FROM a) SELECT id, CASE WHEN listed IS NOT NULL AND h > listed THEN listed ELSE h END AS h, coalesce(listed, 0) > 0 AND h > listed AS capped FROM c")
def capped_parts(spark, sf_dir):
    listed = F.when(F.col("n") > 15, 40)
    over = F.coalesce(F.col("h") > listed, F.lit(False))
    return footprints(spark, sf_dir).select("id", F.when(over, listed).otherwise(F.col("h")).alias("top"), over.alias("capped")).withColumnRenamed("top", "h")


@query("SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1")
def sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_id")
    g = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 1 hour"), 0).otherwise(1)
    s = e.withColumn("g", g).withColumn("s", F.sum("g").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query()
def utm_points(spark, sf_dir):
    x, y = utm(F.col("x") / 1000 + 2.0, F.col("y") / 1000 + 48.0, 31)
    return landmarks(spark, sf_dir).select("id", x.alias("east"), y.alias("north"))


@query()
def distinct_sketch(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
