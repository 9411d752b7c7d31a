"""Queries of street tags, named decks, measured heights and massing profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import shapes as H
from cityloom.functions import tags as T
from cityloom.plans.entities import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def picked(column: str, values: list[str | None]):
    """values[id % n], as a column."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def listed(column: str, values: list[str | None]) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{column} % {len(values)} + 1]"


CLASSES = ["motorway", "trunk", "primary", "primary_link", "residential", "service", "tertiary"]
WALKS = {"trunk": 3.0, "primary": 3.5, "residential": 2.0, "primary_link": 2.5}
STRIPS = {"motorway": 2.0, "trunk": 1.5, "primary": 1.0}
TOLD = [None, "no", "left", "right", "both", "none", None, "yes"]
STREETS = f"SELECT p_partkey AS id, {listed('p_partkey', CLASSES)} AS highway, {listed('p_partkey // 3', TOLD)} AS told, p_size % 2 = 0 AS oneway, p_size % 9 = 0 AS elevated, p_size FROM part"


def streets(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "id").withColumn("_third", F.floor(F.col("id") / 3))
    return part.select("id", picked("id", CLASSES).alias("highway"), picked("_third", TOLD).alias("told"), (F.col("p_size") % 2 == 0).alias("oneway"), (F.col("p_size") % 9 == 0).alias("elevated"), "p_size")


def walks_sql(inner: str) -> str:
    case = lambda values, other: "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" {other} END"
    side = {s: f"CASE WHEN bare OR told IN ('no', 'none') OR told = '{o}' THEN 0.0 ELSE walk END" for s, o in (("left", "right"), ("right", "left"))}
    side[inner] = f"CASE WHEN divided THEN 0.0 ELSE {side[inner]} END"
    return f"""WITH s AS ({STREETS}), v AS (SELECT *, elevated OR highway LIKE '%\\_link' ESCAPE '\\' AS bare, {case(WALKS, 'ELSE 0.0')}::DOUBLE AS walk, {case(STRIPS, '')}::DOUBLE AS strip FROM s),
u AS (SELECT *, oneway AND NOT bare AND strip IS NOT NULL AND coalesce(told NOT IN ('{inner}', 'both'), true) AS divided FROM v)
SELECT id, ({side['left']})::DOUBLE AS "left", ({side['right']})::DOUBLE AS "right", (CASE WHEN divided THEN strip ELSE 0.0 END)::DOUBLE AS median FROM u"""


def walks(spark, sf_dir, right_hand):
    s = streets(spark, sf_dir)
    return s.select("id", T.sidewalks(F.col("told"), F.col("highway"), F.col("oneway"), F.col("elevated"), WALKS, STRIPS, right_hand).alias("w")).select("id", "w.*")


@query(walks_sql("left"))
def sidewalk_widths(spark, sf_dir):
    return walks(spark, sf_dir, True)


@query(walks_sql("right"))
def sidewalk_widths_left_hand(spark, sf_dir):
    return walks(spark, sf_dir, False)


#: (key, value) of one tag a way, and by the rule: on the left kerb, on the right kerb; "two-way": only of two-way ways. Driving on the right.
BUS = [
    ("busway", "lane", "two-way", True), ("busway:left", "opposite_lane", True, False), ("lanes:bus", "1", "two-way", True), ("lanes:psv:forward", "2", False, True),
    ("lanes:bus:backward", "1", True, False), ("bus:lanes", "designated|no|no", True, False), ("bus:lanes:forward", "no|yes", False, True),
    ("psv:lanes:backward", "designated", True, False), ("busway", "no", False, False), ("psv:lanes", "|yes", False, True), ("lanes:bus", "none", False, False), ("busway:both", "opposite_lane", "two-way", True),
]


def bus_sql() -> str:
    says = lambda v: "NOT oneway" if v == "two-way" else str(v).lower()
    rows = " ".join(f"WHEN {k} THEN {{{k}}}" for k in range(len(BUS)))
    left, right = (rows.format(*[says(b[at]) for b in BUS]) for at in (2, 3))
    return f'WITH s AS ({STREETS}) SELECT id, CASE id % {len(BUS)} {left} END AS "left", CASE id % {len(BUS)} {right} END AS "right" FROM s'


@query(bus_sql())
def bus_lanes(spark, sf_dir):
    key, value = (F.element_at(F.array(*[F.lit(b[at]) for b in BUS]), (F.col("id") % len(BUS) + 1).cast("int")) for at in (0, 1))
    s = streets(spark, sf_dir).select("id", "oneway", F.map_from_arrays(F.array(key), F.array(value)).alias("tags"))
    return s.select("id", T.bus_sides(F.col("tags"), F.col("oneway")).alias("b")).select("id", "b.*")


REFS = ["A 1", "B 7; A 40", None, "", "A 40"]


@query(f"""WITH s AS ({STREETS}), v AS (SELECT *, {listed('id', REFS)} AS ref, id % 4 = 0 AS mouth, id % 5 = 0 AS banned, id % 6 = 0 AS painted FROM s)
SELECT id, CASE WHEN id % 5 IN (1, 4) THEN 2 WHEN highway = 'trunk' THEN 2 WHEN mouth AND highway IN ('primary', 'primary_link') THEN 1 WHEN mouth AND banned THEN 1 ELSE 0 END AS kerb, painted AS cycle FROM v""")
def kerbs_and_cycle_lanes(spark, sf_dir):
    s = streets(spark, sf_dir)
    ban, lane = F.when(F.col("id") % 5 == 0, "no_stopping").otherwise("lane"), F.when(F.col("id") % 6 == 0, "opposite_lane").otherwise("track")
    tags = F.create_map(F.lit("ref"), picked("id", REFS), F.lit("parking:lane:both"), ban, F.lit("cycleway:right"), lane)
    s = s.withColumn("tags", tags).withColumn("mouth", F.col("id") % 4 == 0)
    code = T.kerb_lines(F.col("tags"), F.col("highway"), F.col("mouth"), ["A 40"], {"trunk": "red"}, {"primary": "yellow"})
    return s.select("id", code.alias("kerb"), T.cycle_lane(F.col("tags")).alias("cycle"))


DECKS = {"Harbour": {"deck": 40, "lower": 33.5, "rail_lower": True, "water": 12}, "Mill": 18.0, "Old Weir": {"deck": 9}}
SPANS = ["Harbour Bridge", "mill bridge lower level", "Mill Bridge", "HARBOUR bridge (lower)", "Old Weir", "High Street", None]
LOWER_BY = 6.5


@query(f"""WITH s AS (SELECT p_partkey AS id, {listed('p_partkey', SPANS)} AS name, p_size % 3 = 0 AS rails FROM part)
SELECT id, (CASE WHEN name ILIKE '%harbour%' THEN CASE WHEN name ILIKE '%lower%' OR rails THEN 33.5 ELSE 40 END WHEN name ILIKE '%mill%' THEN 18 - CASE WHEN name ILIKE '%lower%' THEN {LOWER_BY} ELSE 0 END
WHEN name = 'Old Weir' THEN 9 END)::DOUBLE AS deck, (CASE WHEN name ILIKE '%harbour%' THEN 12 END)::DOUBLE AS water FROM s""")
def deck_heights(spark, sf_dir):
    s = read(spark, sf_dir, "part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "id").withColumn("name", picked("id", SPANS))
    key, lower = T.span_of([F.col("name")], list(DECKS))
    deck, water = T.deck_heights(key, lower, F.when(F.col("p_size") % 3 == 0, "subway"), DECKS, LOWER_BY)
    return s.select("id", deck.alias("deck"), water.alias("water"))


PARKED = {"primary": 1, "residential": 2, "tertiary": 2}


@query(f"""WITH s AS ({STREETS}), v AS (SELECT *, CASE WHEN id % 4 = 0 THEN 0.0 ELSE 2.4 * CASE highway WHEN 'primary' THEN 1 WHEN 'residential' THEN 2 WHEN 'tertiary' THEN 2 ELSE 0 END END::DOUBLE AS parked FROM s),
u AS (SELECT *, greatest(p_size - parked, 3) / 3.5 AS m FROM v), t AS (SELECT *, CAST(CASE WHEN m - floor(m) = 0.5 THEN 2 * round(m / 2) ELSE round(m) END AS INTEGER) AS fit FROM u)
SELECT id, round(CASE WHEN id % 5 < 2 THEN (1 + id % 3) * 3.25 + CASE WHEN highway IN ('motorway', 'trunk') THEN 2 ELSE 0 END + parked ELSE 7 END, 6)::DOUBLE AS width,
CAST(least(15, CASE WHEN oneway THEN greatest(1, fit) WHEN p_size >= 6 THEN greatest(2, fit) // 2 ELSE 0 END) + CASE WHEN oneway THEN 16 ELSE 0 END
+ CASE WHEN highway IN ('motorway', 'trunk', 'primary', 'primary_link') THEN 32 ELSE 0 END + CASE WHEN highway = 'motorway' THEN 64 ELSE 0 END AS INTEGER) AS code FROM t""")
def parking_lane_widths(spark, sf_dir):
    s = streets(spark, sf_dir).withColumn("tags", F.create_map(F.lit("parking:both"), F.when(F.col("id") % 4 == 0, "no_parking").otherwise("lane")))
    parked, none = T.parking_width(F.col("tags"), F.col("highway"), PARKED), F.lit(None).cast("string")
    lanes = F.when(F.col("id") % 5 < 2, (1 + F.col("id") % 3).cast("string"))
    width = T.road_width(none, F.lit("road"), F.col("highway"), lanes, none, none, default={"link": (7, 7)} | {k: (7, 7) for k in CLASSES}, parked=parked)
    code = T.lane_code(none, F.col("p_size").cast("double"), F.col("oneway"), F.col("highway"), parked)
    return s.select("id", F.round(width, 6).alias("width"), code.alias("code"))


@query("""WITH h AS (SELECT c_custkey AS k, 4 + (c_custkey * 11) % 50 AS seen FROM customer WHERE c_custkey % 3 > 0)
SELECT p_partkey AS id, (CASE WHEN 3 * (1 + p_partkey % 20) > 1.5 * seen THEN NULL ELSE seen END)::DOUBLE AS h FROM part LEFT JOIN h ON k = p_partkey""")
def newer_than_measured(spark, sf_dir):
    seen = read(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 > 0").selectExpr("c_custkey as id", "cast(4 + (c_custkey * 11) % 50 as double) as seen")
    b = read(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey as id", "3.0D * (1 + p_partkey % 20) as storeys")
    return b.join(seen, "id", "left").select("id", T.seen_height(F.col("seen"), F.col("storeys")).alias("h"))


PROFILES = ["0:1 0.9:1 1:0.8", "dome:0.4", "shell:0.5:6", "anti:0.25", "long:0:1:1 1:1:0.02", "lean:135:0.2:1 1:0.6", "", None]
CURVED = "sin(k * pi() / 16)"


@query(f"""WITH s AS (SELECT p_partkey AS id, p_partkey % {len(PROFILES)} AS c FROM part), r AS (SELECT range AS k FROM range(9)),
knots AS (
    SELECT id, 0 AS nth, 0.0 AS at, 1.0 AS along, 1.0 AS across, 0.0 AS inset, 0.0 AS turn, NULL AS bearing FROM s WHERE c IN (0, 1, 2, 3, 4)
    UNION ALL SELECT id, 1, 0.9, 1, 1, 0, 0, NULL FROM s WHERE c = 0 UNION ALL SELECT id, 2, 1, 0.8, 0.8, 0, 0, NULL FROM s WHERE c = 0
    UNION ALL SELECT id, k + 1, 0.4 + 0.6 * {CURVED}, greatest(cos(k * pi() / 16), 0.08), greatest(cos(k * pi() / 16), 0.08), 0, 0, NULL FROM s, r WHERE c = 1
    UNION ALL SELECT id, k + 1, 0.5 + 0.5 * {CURVED}, 1, 1, 6 * (1 - cos(k * pi() / 16)), 0, NULL FROM s, r WHERE c = 2
    UNION ALL SELECT id, 1, 0.25, 1, 1, 0, 0, NULL FROM s WHERE c = 3 UNION ALL SELECT id, 2, 1, sqrt(0.5), sqrt(0.5), 0, 45, NULL FROM s WHERE c = 3
    UNION ALL SELECT id, 1, 1, 1, 0.02, 0, 0, NULL FROM s WHERE c = 4
    UNION ALL SELECT id, 0, 0.2, 1, 1, 0, 0, 135 FROM s WHERE c = 5 UNION ALL SELECT id, 1, 1, 0.6, 1, 0, 0, 135 FROM s WHERE c = 5)
SELECT id, CAST(nth AS INTEGER) AS nth, round(at, 6)::DOUBLE AS at, round(along, 6)::DOUBLE AS along, round(across, 6)::DOUBLE AS across, round(inset, 6)::DOUBLE AS inset, turn::DOUBLE AS turn, bearing::DOUBLE AS bearing FROM knots""".replace(" AS at", " AS height").replace("round(at, 6)", "round(height, 6)"))
def massing_knots(spark, sf_dir):
    s = read(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "id").withColumn("text", picked("id", PROFILES))
    k = s.select("id", F.posexplode(H.knots(F.col("text"))).alias("nth", "k"))
    return k.select("id", "nth", *[F.round(f"k.{c}", 6).alias(c) for c in ("height", "along", "across", "inset", "turn", "bearing")])


CELLS = ["dome:0.4; crown@1:0:1:#aabbcc", "h@12", " ;tops@3;0:1 1:0.5", None, "shell:0.5:6;lid@x;wing@y"]


@query(f"""SELECT p_partkey AS id, {listed('p_partkey', ['dome:0.4', None, '0:1 1:0.5', None, 'shell:0.5:6'])} AS profile, {listed('p_partkey', ['crown@1:0:1:#aabbcc', 'h@12', 'tops@3', '', 'lid@x|wing@y'])} AS directives FROM part""")
def massing_directives(spark, sf_dir):
    s = read(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "id")
    profile, parts = H.directives(picked("id", CELLS))
    return s.select("id", profile.alias("profile"), F.array_join(parts, "|").alias("directives"))
