"""Queries of filters, tag functions, closed forms and the fusion steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import shapes as H
from cityloom.functions import tags as T
from cityloom.operators import fuse as U
from cityloom.operators import dense as D
from cityloom.operators import spatial as S
from cityloom.plans.entities import WITH, footprints, landmarks, outlines, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TAG = """CASE p_partkey % 7 WHEN 0 THEN p_size || '''' WHEN 1 THEN p_size || '''6"' WHEN 2 THEN p_size || ';' || (p_partkey % 40) WHEN 3 THEN p_size || ',5 m' WHEN 4 THEN p_size || ' ft' WHEN 5 THEN 'none' END"""
LEVEL = "CASE p_partkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN '-2;-1' WHEN 2 THEN '0;-1' WHEN 3 THEN 'B1' END"
HIGHWAY = "CASE p_partkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'residential' WHEN 3 THEN 'service' WHEN 4 THEN 'trunk' ELSE 'footway' END"
WAYS = f"SELECT p_partkey AS id, {TAG} AS tag, {LEVEL} AS level, {HIGHWAY} AS highway, CASE WHEN p_partkey % 11 = 0 THEN 'rail' END AS railway, CASE WHEN p_partkey % 4 = 0 THEN 'driveway' END AS service, CASE WHEN p_partkey % 3 = 0 THEN CAST(1 + p_partkey % 5 AS VARCHAR(9)) END AS lanes, p_partkey % 2 = 0 AS oneway, p_size, p_name, p_retailprice FROM part"


def ways(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name", "p_retailprice")
    text = WAYS.replace("'''6\"'", "'\\'6\"'").replace("''''", "'\\''").replace("VARCHAR(9)", "STRING")
    return part.selectExpr(*[c.strip() for c in split_columns(text.removeprefix("SELECT ").removesuffix(" FROM part"))])


def split_columns(text: str) -> list[str]:
    """At commas outside of parentheses and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'" and text[i - 1] != "\\"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


FEET = r"^([0-9.]+)\s*(?:''|ft|feet)\s*(?:([0-9.]+)\s*(?:\"|in))?$".replace('\\"', '"')
ONE = "CASE WHEN regexp_matches({x}, '{f}') THEN TRY_CAST(regexp_extract({x}, '{f}', 1) AS DOUBLE) * 0.3048 + coalesce(TRY_CAST(regexp_extract({x}, '{f}', 2) AS DOUBLE) * 0.0254, 0) ELSE TRY_CAST(regexp_extract({x}, '^([0-9.]+)', 1) AS DOUBLE) END"


@query(f"""WITH w AS ({WAYS}), u AS (SELECT id, tag, unnest(string_split(replace(tag, ',', '.'), ';')) AS x FROM w)
SELECT w.id, m FROM w LEFT JOIN (SELECT id, round(max({ONE.format(x='lower(trim(x))', f=FEET)}), 6) AS m FROM u GROUP BY 1) v ON v.id = w.id""")
def tag_height_m(spark, sf_dir):
    return ways(spark, sf_dir).select("id", F.round(T.height_m(F.col("tag")), 6).alias("m"))


@query(f"""WITH w AS ({WAYS}) SELECT id, round(CASE WHEN regexp_matches(lower(trim(tag)), '{FEET}') THEN {ONE.format(x='lower(trim(tag))', f=FEET)}
ELSE TRY_CAST(string_split(trim(string_split(replace(tag, ',', '.'), ';')[1]), ' ')[1] AS DOUBLE) END, 6) AS m FROM w""")
def tag_length_m(spark, sf_dir):
    return ways(spark, sf_dir).select("id", F.round(T.length_m(F.col("tag")), 6).alias("m"))


@query(f"WITH w AS ({WAYS}) SELECT id, level IN ('-1', '-2;-1') AND level IS NOT NULL AS below FROM w")
def tag_level(spark, sf_dir):
    return ways(spark, sf_dir).select("id", T.below_ground(F.col("level")).alias("below"))


@query(f"WITH w AS ({WAYS}) SELECT id FROM w WHERE NOT (coalesce(level IN ('-1', '-2;-1'), false) OR p_size % 9 = 0 OR p_size % 7 = 0)")
def underground_filter(spark, sf_dir):
    w = ways(spark, sf_dir)
    location = F.when(F.col("p_size") % 9 == 0, "underground")
    return w.where(~T.underground(location, F.when(F.col("p_size") % 7 == 0, "-1"), F.col("level"), F.lit(None).cast("string"))).select("id")


CLASS = "CASE WHEN railway = 'rail' THEN 'rail' WHEN highway IN ('motorway', 'trunk', 'primary_link') THEN 'major' WHEN highway = 'residential' THEN 'minor' WHEN highway = 'service' AND service IS NULL THEN 'service' END"


@query(f"WITH w AS ({WAYS}) SELECT id, {CLASS} AS class FROM w")
def road_class(spark, sf_dir):
    return ways(spark, sf_dir).select("id", T.road_class(F.col("railway"), F.col("highway"), F.col("service"), F.lit(None).cast("string")).alias("class"))


DEFAULTS = {"motorway": (24, 12), "trunk": (20, 10), "link": (9, 5), "residential": (7, 5), "service": (5, 4), "footway": (3, 3)}


@query(f"""SELECT id, round(width0, 6) AS width FROM (WITH w AS ({WAYS}) SELECT id, CASE WHEN p_size BETWEEN 20 AND 30 THEN CAST(p_size AS DOUBLE) WHEN railway = 'rail' THEN 3.2 * (1 + p_size % 3)
WHEN lanes IS NOT NULL THEN CAST(lanes AS DOUBLE) * 3.25 + CASE WHEN highway IN ('motorway', 'trunk') THEN 2 ELSE 0 END
ELSE CASE highway WHEN 'motorway' THEN CASE WHEN oneway THEN 12.0 ELSE 24 END WHEN 'trunk' THEN CASE WHEN oneway THEN 10.0 ELSE 20 END WHEN 'primary_link' THEN CASE WHEN oneway THEN 5.0 ELSE 9 END
WHEN 'residential' THEN CASE WHEN oneway THEN 5.0 ELSE 7 END WHEN 'service' THEN CASE WHEN oneway THEN 4.0 ELSE 5 END ELSE 3.0 END END::DOUBLE AS width0 FROM w)""")
def road_width(spark, sf_dir):
    w = ways(spark, sf_dir)
    tagged = F.when(F.col("p_size").between(20, 30), F.col("p_size").cast("string")).otherwise(F.lit("200"))
    kind = F.when(F.col("railway") == "rail", "rail").otherwise("road")
    width = T.road_width(tagged, kind, F.col("highway"), F.col("lanes"), (1 + F.col("p_size") % 3).cast("string"), F.when(F.col("oneway"), "yes"), default=DEFAULTS)
    return w.select("id", F.round(width, 6).alias("width"))


@query(f"""WITH w AS ({WAYS}), v AS (SELECT *, greatest(p_size, 3) / 3.5 AS moving FROM w), u AS (SELECT *, CAST(CASE WHEN moving - floor(moving) = 0.5 THEN 2 * round(moving / 2) ELSE round(moving) END AS INTEGER) AS fit FROM v)
SELECT id, CAST(least(15, CASE WHEN oneway THEN coalesce(CAST(lanes AS INTEGER), greatest(1, fit)) ELSE CASE WHEN CAST(lanes AS INTEGER) >= 2 THEN CAST(lanes AS INTEGER) WHEN p_size >= 6 THEN greatest(2, fit) ELSE 0 END // 2 END)
+ CASE WHEN oneway THEN 16 ELSE 0 END + CASE WHEN highway IN ('motorway', 'trunk', 'primary_link') THEN 32 ELSE 0 END + CASE WHEN highway = 'motorway' THEN 64 ELSE 0 END AS INTEGER) AS code FROM u""")
def lane_code(spark, sf_dir):
    return ways(spark, sf_dir).select("id", T.lane_code(F.col("lanes"), F.col("p_size").cast("double"), F.col("oneway"), F.col("highway")).alias("code"))


@query(f"WITH w AS ({WAYS}) SELECT id, round(CASE WHEN id % 3 = 0 THEN p_size * 1.609 WHEN id % 3 = 1 THEN p_size END, 6)::DOUBLE AS kmh FROM w")
def max_speed(spark, sf_dir):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.col("p_size"), F.lit(" mph"))).when(F.col("id") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.lit("signals"))
    return ways(spark, sf_dir).select("id", F.round(T.max_speed(text), 6).alias("kmh"))


@query(f"WITH w AS ({WAYS}) SELECT id, CASE WHEN id % 4 = 0 THEN false WHEN id % 4 = 1 THEN true WHEN id % 4 = 2 THEN false END AS parked FROM w")
def parking_sides(spark, sf_dir):
    tags = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("parking:left:restriction"), F.lit("no_parking"), F.lit("parking:both"), F.lit("lane")))
    tags = tags.when(F.col("id") % 4 == 1, F.create_map(F.lit("parking:both"), F.lit("street_side"))).when(F.col("id") % 4 == 2, F.create_map(F.lit("parking:lane:left"), F.lit("no_stopping")))
    tags = tags.otherwise(F.create_map(F.lit("parking:left"), F.lit("unknown")))
    return ways(spark, sf_dir).select("id", tags.alias("tags")).select("id", T.parking(F.col("tags"), "left").alias("parked"))


@query("SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), '1') THEN '1' WHEN contains(lower(p_name), '7') THEN '7' WHEN contains(p_brand, '3') THEN '3' END AS span FROM part")
def span_of(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    first, _ = T.span_of([F.col("p_name")], ["1", "7"])
    second, _ = T.span_of([F.col("p_brand")], ["3"])
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(first, second).alias("span"))


@query("SELECT s_suppkey AS id, lower(s_name) AS plain, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1900 + s_suppkey % 100 WHEN s_suppkey % 3 = 1 THEN 1850 END AS INTEGER) AS year FROM supplier")
def names_and_years(spark, sf_dir):
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    built = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("c. "), 1900 + F.col("s_suppkey") % 100)).otherwise(F.lit("9999"))
    return s.select(F.col("s_suppkey").alias("id"), T.plain_name(F.concat("s_name", F.lit(" (old)"))).alias("plain"), T.year_of(built, F.when(F.col("s_suppkey") % 3 == 1, "1850-60")).alias("year"))


@query(f"""{WITH} SELECT id, round(CASE WHEN h - 5 <= 0 THEN 0 WHEN h - 5 < 8 THEN (h - 5) ** 2 / 16.0 ELSE h - 9 END, 6) AS knee,
round(CASE WHEN h <= 10 THEN 0 WHEN h >= 40 THEN 1 ELSE ((h - 10) / 30.0) ** 2 * (3 - 2 * (h - 10) / 30.0) END, 6) AS ramp,
CASE WHEN h <= 10 THEN 7.0 WHEN h <= 30 THEN 7 + (h - 10) / 20.0 * 7 ELSE 14 END::DOUBLE AS line FROM a""")
def ramps(spark, sf_dir):
    h = F.col("h").cast("double")
    return footprints(spark, sf_dir).select("id", F.round(H.soft_knee(h, 5, 4), 6).alias("knee"), F.round(H.smooth_ramp(h, 10, 30), 6).alias("ramp"), H.interpolated(h, [10, 30], [7, 14]).alias("line"))


@query(f"""{WITH}, d AS (SELECT id, h, greatest(sqrt(CAST((x0 * 100) ** 2 + (y0 * 100) ** 2 AS DOUBLE)) - 12000, 0) ** 2 / (2 * 6371000.0::DOUBLE / (1 - 0.13::DOUBLE)) AS d FROM a)
SELECT id, round(d, 5) AS d, round(h * h / greatest(h + d, 1e-6), 5) AS seen FROM d""")
def curvature(spark, sf_dir):
    drop = H.earth_drop((F.col("x0") * 100).cast("double"), (F.col("y0") * 100).cast("double"))
    return footprints(spark, sf_dir).select("id", F.round(drop, 5).alias("d"), F.round(H.curved(F.col("h").cast("double"), drop), 5).alias("seen"))


@query(f"{WITH} SELECT id, round(CASE WHEN n % 20 = 19 THEN 200.0 ELSE 100 - least(h, 100) + (least(h, 100) + 100) * ln(20.0 / (n % 20 + 1)) / (1 - (n % 20 + 1) / 20.0) END, 6)::DOUBLE AS p FROM a")
def warp_length(spark, sf_dir):
    k = (F.col("n") % 20 + 1) / 20.0
    return footprints(spark, sf_dir).select("id", F.round(H.queue_length(F.lit(200.0), F.lit(100.0), F.col("h").cast("double"), k), 6).alias("p"))


@query(f"""{WITH}, c AS (SELECT id, (id * 37) % 256 AS r FROM a) SELECT id, CAST(r AS INTEGER) AS red, round(CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END, 6) AS linear FROM c""")
def palette(spark, sf_dir):
    colour = F.format_string("#%02x%02x%02x", (F.col("id") * 37) % 256, F.lit(0).cast("long"), F.lit(255).cast("long"))
    red = H.channel(colour, 0)
    return footprints(spark, sf_dir).select("id", red.alias("red"), F.round(H.linear(red), 6).alias("linear"))


@query(f"{WITH} SELECT id, CAST(CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END + 2 * least(127, h * 2) AS INTEGER) AS cyl, CAST(least(127, n * 6) + CASE WHEN h % 2 = 1 THEN 128 ELSE 0 END AS INTEGER) AS panel FROM a")
def bit_fields(spark, sf_dir):
    a = footprints(spark, sf_dir)
    return a.select("id", H.cylinder_bits(F.col("n") % 2 == 1, F.col("h") * 0.1).alias("cyl"), H.panel_bits(F.col("n") * 6 / 127, F.col("h") % 2 == 1).alias("panel"))


@query("WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_linenumber) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(v, lambda x: printf('%02X', x % 256)), '') || array_to_string(list_transform(v, lambda x: printf('%02X', x // 256 % 256)), '') AS body FROM g")
def split16(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    return g.select("l_orderkey", F.hex(H.split_bytes(F.col("v"))).alias("body"))


@query("SELECT l_orderkey * 2654435761 % 1000 / 1000.0::DOUBLE AS share, count(*) AS n FROM lineitem GROUP BY 1")
def id_hash(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_orderkey").select(H.id_share(F.col("l_orderkey")).alias("share")).groupBy("share").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 'dome' AS name, p_size / 10.0::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'crown', NULL FROM part")
def parse_profile(spark, sf_dir):
    text = F.concat(F.lit("dome:"), F.col("p_size") / 10, F.lit(", crown"))
    p = read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("id"), F.explode(H.profile(text)).alias("p"))
    return p.select("id", "p.name", "p.value")


KIND = "CASE WHEN h >= 50 THEN 'tower' WHEN src = 'osm' AND n > 10 THEN 'office' WHEN {area} < 150 THEN 'house' WHEN n > 12 THEN 'flats' ELSE 'other' END"


@query(f"{WITH} SELECT id, {KIND.format(area='(x1 - x0) * (y1 - y0)')} AS kind, CASE WHEN h >= 50 THEN 'glass' WHEN kind LIKE '%#1%' THEN 'brick' ELSE 'plaster' END AS style FROM a")
def kind_decision_list(spark, sf_dir):
    c = F.col
    kind = H.decided("other", [(c("n") > 12, "flats"), (S.area() < 150, "house"), ((c("src") == "osm") & (c("n") > 10), "office"), (c("h") >= 50, "tower")])
    style = H.decided("plaster", [(c("kind").contains("#1"), "brick"), (c("h") >= 50, "glass")])
    return footprints(spark, sf_dir).select("id", kind.alias("k"), style.alias("style")).withColumnRenamed("k", "kind")


@query(f"{WITH} SELECT id, (x1 - x0) * (y1 - y0) AS area, greatest(x1 - x0, y1 - y0) AS length, greatest(0.1, least(x1 - x0, y1 - y0))::DOUBLE AS width, round(greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0)::DOUBLE, 6) AS aspect FROM a")
def shape_stats(spark, sf_dir):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    narrow = F.greatest(F.lit(0.1), F.least(w, h).cast("double"))
    return footprints(spark, sf_dir).select("id", (w * h).alias("area"), F.greatest(w, h).alias("length"), narrow.alias("width"), F.round(F.greatest(w, h) / narrow, 6).alias("aspect"))


@query(f"{WITH} SELECT id FROM a WHERE least(x1 - x0, y1 - y0) >= 8 OR src = 'osm' OR n > 18")
def strip_cleanup(spark, sf_dir):
    keep = (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= 8) | (F.col("src") == "osm") | (F.col("n") > 18)
    return footprints(spark, sf_dir).where(keep).select("id")


@query(f"{WITH} SELECT a.id, CASE WHEN a.n % 5 = 0 THEN 99 ELSE a.h END AS h FROM a WHERE a.id % 13 <> 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.id % 13 = 0 AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1)")
def overrides(spark, sf_dir):
    a, b = footprints(spark, sf_dir), outlines(spark, sf_dir).where("id % 13 = 0")
    gone = S.inside(b, a, 1.0).select(F.col("b_id").alias("id"))
    return a.where("id % 13 <> 0").join(gone, "id", "left_anti").select("id", F.when(F.col("n") % 5 == 0, 99).otherwise(F.col("h")).alias("h"))


@query(f"{WITH} SELECT id FROM a WHERE id * 2654435761 % 1000 / 1000.0 < greatest(0.05, 1 - sqrt(CAST((x0 - 500) ** 2 + (y0 - 500) ** 2 AS DOUBLE)) / 700) * CASE WHEN h > 40 THEN 3 WHEN h > 25 THEN 1.6 ELSE 1 END")
def thin_by_hash(spark, sf_dir):
    far = F.sqrt((F.col("x0") - 500) * (F.col("x0") - 500) + (F.col("y0") - 500) * (F.col("y0") - 500))
    p = F.greatest(F.lit(0.05), 1 - far / 700) * F.when(F.col("h") > 40, 3.0).when(F.col("h") > 25, 1.6).otherwise(1.0)
    return footprints(spark, sf_dir).where(H.id_share(F.col("id")) < p).select("id")


@query(f"{WITH} SELECT DISTINCT CAST(x0 // 100 AS BIGINT) AS tx, CAST(y0 // 100 AS BIGINT) AS ty FROM a WHERE (greatest(0, x0 // 100 * 100 - 400, 400 - x0 // 100 * 100 - 100)) ** 2 + (greatest(0, y0 // 100 * 100 - 600, 600 - y0 // 100 * 100 - 100)) ** 2 <= 90000")
def radius_cull(spark, sf_dir):
    t = footprints(spark, sf_dir).select(F.expr("x0 div 100").alias("tx"), F.expr("y0 div 100").alias("ty")).distinct()
    far = lambda c, p: F.greatest(F.lit(0), F.col(c) * 100 - p, p - F.col(c) * 100 - 100)
    return t.where(far("tx", 400) * far("tx", 400) + far("ty", 600) * far("ty", 600) <= 90_000)


# --- fusion -----------------------------------------------------------------------------------------------------------

HEIGHTS = "SELECT l_orderkey, l_linenumber, l_partkey, NULLIF(l_partkey % 5, 0) AS ha, NULLIF(l_suppkey % 4, 0) * 10 AS hb, CASE WHEN l_quantity > 25 THEN l_quantity END AS hc FROM lineitem"


def heights(spark, sf_dir):
    text = HEIGHTS.removeprefix("SELECT ").removesuffix(" FROM lineitem")
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").selectExpr(*split_columns(text))


@query(f"WITH s AS ({HEIGHTS}) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(hc, hb, ha, 6.4)::DOUBLE AS h, CASE WHEN hc IS NOT NULL THEN 'c' WHEN hb IS NOT NULL THEN 'b' WHEN ha IS NOT NULL THEN 'a' ELSE 'default' END AS h_src FROM s")
def height_priority(spark, sf_dir):
    h, name = U.prioritised([(c, F.col(f"h{c}").cast("double")) for c in "cba"], F.lit(6.4))
    return heights(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", h.alias("h"), name.alias("h_src"))


@query(f"WITH s AS ({HEIGHTS}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (hb + hc) / 2 BETWEEN 20 AND 35 THEN round(0.25 * hb + 0.75 * hc, 6) END::DOUBLE AS h FROM s")
def blend_band(spark, sf_dir):
    h = U.blended(F.col("hb").cast("double"), F.col("hc"), (0.25, 0.75), (20, 35))
    return heights(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round(h, 6).alias("h"))


RULES = [
    U.Rule("drop", "kiosk", limits={"area_below": 40, "h_below": 10}),
    U.Rule("exact", "memorial", field="kind", values=("brand#11", "BRAND#12"), limits={"h_below": 20}),
    U.Rule("roof", "canopy", source="osm", field="kind", prefix=("Brand#2", "Brand#3")),
    U.Rule("keep", None, limits={"h_from": 50}),
]
RULED = "CASE WHEN {a} < 40 AND h < 10 THEN 0 WHEN lower(kind) IN ('brand#11', 'brand#12') AND h < 20 THEN 1 WHEN src = 'osm' AND (kind LIKE 'Brand#2%' OR kind LIKE 'Brand#3%') THEN 2 WHEN h >= 50 THEN 3 END".format(a="(x1 - x0) * (y1 - y0)")


@query(f"{WITH}, r AS (SELECT *, {RULED} AS no FROM a) SELECT id, CAST(no AS INTEGER) AS rule_no, CASE no WHEN 0 THEN 'kiosk' WHEN 1 THEN 'memorial' WHEN 2 THEN 'canopy' WHEN 3 THEN 'keep' END AS rule, coalesce(no IN (1, 2, 3), false) AS keep_small, coalesce(no IN (1, 2), false) AS h_exact FROM r WHERE coalesce(no, 9) <> 0")
def rule_first_match(spark, sf_dir):
    r = U.ruled(footprints(spark, sf_dir).withColumn("area", S.area()), RULES)
    return r.where(~F.col("dropped")).select("id", "rule_no", "rule", "keep_small", "h_exact")


@query(f"{WITH}, r AS (SELECT *, {RULED} AS no FROM a) SELECT CAST(no AS INTEGER) AS rule_no, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM r WHERE no IS NOT NULL GROUP BY 1")
def rule_audit(spark, sf_dir):
    return U.rule_counts(U.ruled(footprints(spark, sf_dir).withColumn("area", S.area()), RULES)).select("rule_no", "n", "area")


SPIKES = f"{WITH}, s AS (SELECT id, h::DOUBLE AS h, h * 0.4::DOUBLE AS mean, CASE WHEN n % 3 > 0 THEN n * 2.0::DOUBLE END AS listed FROM a)"


@query(f"""{SPIKES}, e AS (SELECT *, CASE WHEN h > greatest(listed + 15, listed * 1.2) AND mean < listed + 15 THEN listed END AS l, CASE WHEN listed IS NULL AND h > 2.4 * mean THEN mean * 1.2 END AS m FROM s)
SELECT id, round(CASE WHEN least(h, coalesce(l, m, h)) < h - 1 THEN coalesce(l, m) ELSE h END, 6) AS h, CASE WHEN coalesce(l, m) < h - 1 THEN CASE WHEN l IS NOT NULL THEN 'osm' ELSE 'mean' END END AS mark FROM e""")
def despike(spark, sf_dir):
    s = footprints(spark, sf_dir).selectExpr("id", "cast(h as double) as h", "h * 0.4D as mean", "if(n % 3 > 0, n * 2.0D, null) as listed")
    h, mark = U.despiked(F.col("h"), F.col("mean"), F.col("listed"), 15, 1.2)
    return s.select("id", F.round(h, 6).alias("h2"), mark.alias("mark")).withColumnRenamed("h2", "h")


@query(f"""{WITH}, s AS (SELECT id, n, h, (id * 13) % 90 AS v, (id * 17) % 120 AS u FROM a), t AS (SELECT *, CASE WHEN v > h + greatest(10, 0.3 * h) AND v <= 4.5 * n + 15 THEN v ELSE h END AS h1 FROM s)
SELECT id, CASE WHEN u > h1 + greatest(10, 0.3 * h1) AND u <= 4.5 * n + 15 THEN u ELSE h1 END AS h FROM t""")
def reconcile(spark, sf_dir):
    a = footprints(spark, sf_dir)
    return a.select("id", U.reconciled(F.col("h"), [(F.col("id") * 13) % 90, (F.col("id") * 17) % 120], F.col("n")).alias("h"))


@query(f"""{WITH}, f AS (SELECT id, h, round(CASE WHEN n = 3 THEN h ELSE greatest(h, 5) END, 1)::DOUBLE AS height FROM a) SELECT id, height, CAST(greatest(1, round(h / 4.3)) AS INTEGER) AS floors FROM f""")
def finish_heights(spark, sf_dir):
    a = footprints(spark, sf_dir)
    h = U.finished(F.col("h").cast("double"), S.area().cast("double"), F.col("n") == 3, 5.0)
    return a.select("id", h.alias("height"), U.floors(F.col("h").cast("double"), 4.3).alias("floors"))


@query(f"""{WITH}, m AS (SELECT b.id, max(p.h) AS listed FROM p JOIN b ON b.x0 <= p.x AND p.x <= b.x1 AND b.y0 <= p.y AND p.y <= b.y1 GROUP BY 1)
SELECT b.id, CASE WHEN listed IS NULL THEN b.h ELSE listed END AS h, listed IS NOT NULL AS landmark FROM b LEFT JOIN m ON m.id = b.id""")
def landmark_heights(spark, sf_dir):
    m = S.containing(landmarks(spark, sf_dir), outlines(spark, sf_dir)).groupBy(F.col("b_id").alias("id")).agg(F.max("p_h").alias("listed"))
    return outlines(spark, sf_dir).join(m, "id", "left").select("id", F.coalesce("listed", "h").alias("h"), F.col("listed").isNotNull().alias("landmark"))


MEETS = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query(f"""{WITH}, t AS (SELECT a.id AS i, b.id AS j FROM a JOIN a AS b ON a.id < b.id AND {MEETS} WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.1 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))
SELECT 'strips' AS name, count(*) AS n FROM a WHERE least(x1 - x0, y1 - y0) < 3 UNION ALL SELECT 'low', count(*) FROM a WHERE h < 5 UNION ALL SELECT 'tall', count(*) FROM a WHERE h > 55
UNION ALL SELECT 'overlaps', count(*) FROM t UNION ALL SELECT 'doubles', count(*) - count(DISTINCT (x0, y0, x1, y1)) FROM a""")
def quality_report(spark, sf_dir):
    a = footprints(spark, sf_dir)
    flags = {"strips": F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < 3, "low": F.col("h") < 5, "tall": F.col("h") > 55}
    one = a.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in flags.items()], (F.count("*") - F.countDistinct("x0", "y0", "x1", "y1")).alias("doubles"))
    rows = one.unpivot([], ["strips", "low", "tall", "doubles"], "name", "n")
    worst = D.overlaps(a, 0.1).select(F.lit("overlaps").alias("name"), "n")
    return rows.unionAll(worst)


@query(f"""{WITH}, j AS (SELECT a.id AS a_id, b.h, row_number() OVER (PARTITION BY a.id ORDER BY (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) DESC, b.id) AS k FROM a JOIN b ON {MEETS}),
m AS (SELECT a.src, a.h AS got, j.h AS want FROM a JOIN j ON j.a_id = a.id AND k = 1)
SELECT a.src, count(*) AS n, any_value(c.matched) AS matched, any_value(c.median_error) AS median_error FROM a JOIN (SELECT src, count(*) AS matched, median(got - want) AS median_error FROM m GROUP BY 1) c ON c.src = a.src GROUP BY 1""")
def compare_report(spark, sf_dir):
    a, b = footprints(spark, sf_dir), outlines(spark, sf_dir)
    m = S.best_match(a, b).join(b.select(F.col("id").alias("b_id"), F.col("h").alias("want")), "b_id").select(F.col("a_id").alias("id"), "want")
    j = a.select("id", "src", "h").join(m, "id", "left")
    return j.groupBy("src").agg(F.count("*").alias("n"), F.count("want").alias("matched"), F.median(F.col("h") - F.col("want")).alias("median_error"))
