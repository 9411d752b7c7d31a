"""Queries of aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.functions.hilbert import hilbert, hilbert_sql
from cityloom.operators import aggregate as A
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


# --- aggregations -----------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT src, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 9) AS share FROM a GROUP BY 1")
def source_share(spark, sf_dir):
    return A.shares(footprints(spark, sf_dir), "src").select("src", "n", F.round("share", 9).alias("share"))


@query(f"{WITH} SELECT src, kind, count(*) AS n, median(h) AS median_h, max(h) AS max_h FROM a GROUP BY 1, 2")
def source_summary(spark, sf_dir):
    return footprints(spark, sf_dir).groupBy("src", "kind").agg(F.count("*").alias("n"), F.median("h").alias("median_h"), F.max("h").alias("max_h"))


@query(f"{WITH} SELECT CAST(x0 // 50 AS BIGINT) AS cx, CAST(y0 // 50 AS BIGINT) AS cy, count(*) AS n, CAST(sum(h) AS BIGINT) AS total, round(avg(CASE WHEN h > 30 THEN 1.0 ELSE 0.0 END), 9) AS tall FROM a GROUP BY 1, 2")
def grid_counts(spark, sf_dir):
    tall = F.round(F.avg(F.when(F.col("h") > 30, 1.0).otherwise(0.0)), 9).alias("tall")
    return A.grid(footprints(spark, sf_dir), 50, F.count("*").alias("n"), F.sum("h").alias("total"), tall, x="x0", y="y0")


@query(f"{WITH} SELECT CAST(x0 // 100 AS BIGINT) AS cx, CAST(y0 // 100 AS BIGINT) AS cy, count(*) AS n, round(quantile_cont(h, 0.9), 6) AS p90 FROM a GROUP BY 1, 2")
def grid_p90(spark, sf_dir):
    return A.grid(footprints(spark, sf_dir), 100, F.count("*").alias("n"), F.round(F.percentile("h", 0.9), 6).alias("p90"), x="x0", y="y0")


@query("""WITH e AS (SELECT l_linenumber AS band, CAST(l_partkey AS DOUBLE) AS got, CAST(l_suppkey * 20 AS DOUBLE) AS want FROM lineitem)
SELECT band, count(*) AS n, median(got - want) AS median_error, median(abs(got - want)) AS median_abs, round(sqrt(avg((got - want) ** 2)), 6) AS rmse, round(corr(got, want), 9) AS r FROM e GROUP BY 1""")
def error_metrics_bands(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey").selectExpr("l_linenumber as band", "cast(l_partkey as double) as got", "l_suppkey * 20.0D as want")
    return A.error_metrics(e, "got", "want", "band").withColumns({"rmse": F.round("rmse", 6), "r": F.round("r", 9)})


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, median(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, CASE WHEN n >= 600 THEN m ELSE (SELECT median(l_quantity) FROM lineitem) END AS median FROM g""")
def cell_median_fallback(spark, sf_dir):
    return A.median_or_global(read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 600)


@query("""WITH c AS (SELECT l_orderkey, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS cum, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, min(l_partkey) AS l_partkey, any_value(total) AS cover FROM c WHERE cum * 2 >= total GROUP BY 1""")
def weighted_median(spark, sf_dir):
    return A.weighted_median(read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), "l_orderkey", "l_partkey", "l_quantity", "l_linenumber")


INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query(f"""{WITH}, o AS (SELECT b.id, a.id AS piece, a.h, {INTER} AS w FROM b JOIN a ON {MEET}),
c AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY h, piece ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY id) AS total FROM o),
m AS (SELECT id, min(h) AS h FROM c WHERE cum * 2 >= total GROUP BY 1), mean AS (SELECT id, sum(h * w) / sum(w) AS h_mean, CAST(sum(w) AS BIGINT) AS cover FROM o GROUP BY 1)
SELECT id, h, round(h_mean, 6) AS h_mean, cover FROM m JOIN mean USING (id)""")
def overlay_heights(spark, sf_dir):
    return D.overlay(outlines(spark, sf_dir), footprints(spark, sf_dir)).withColumn("h_mean", F.round("h_mean", 6))


@query("""WITH c AS (SELECT l_orderkey, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS cum FROM lineitem)
SELECT l_orderkey, coalesce(max(CASE WHEN cum >= 60 THEN l_partkey END), min(l_partkey)) AS l_partkey FROM c GROUP BY 1""")
def main_roof(spark, sf_dir):
    return A.main_roof(read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", 60)


@query(f"""{WITH}, c AS (SELECT x0 // 50 AS cx, y0 // 50 AS cy, 1900 + n AS year FROM a WHERE n % 4 > 0),
m AS (SELECT cx + dx AS cx, cy + dy AS cy, year FROM c, (VALUES (-1), (0), (1)) t(dx), (VALUES (-1), (0), (1)) u(dy)),
g AS (SELECT cx, cy, median(year) AS year, count(*) AS n FROM m GROUP BY 1, 2)
SELECT a.id, CASE WHEN g.n >= 5 THEN g.year END AS year FROM a LEFT JOIN g ON a.x0 // 50 = g.cx AND a.y0 // 50 = g.cy""")
def neighbour_median(spark, sf_dir):
    a = footprints(spark, sf_dir).selectExpr("id", "x0 div 50 as cx", "y0 div 50 as cy", "if(n % 4 > 0, 1900 + n, null) as year")
    spread = a.where("year is not null").select(F.explode(F.expr("sequence(cx - 1, cx + 1)")).alias("cx"), "cy", "year").select("cx", F.explode(F.expr("sequence(cy - 1, cy + 1)")).alias("cy"), "year")
    g = spread.groupBy("cx", "cy").agg(F.median("year").alias("m"), F.count("*").alias("k"))
    return a.join(g, ["cx", "cy"], "left").select("id", F.when(F.col("k") >= 5, F.col("m")).alias("year"))


@query(f"{WITH} SELECT id, max(h > 58) OVER (PARTITION BY x0 // 50, y0 // 50) AS tower_cell FROM a")
def any_in_cell(spark, sf_dir):
    return footprints(spark, sf_dir).select("id", F.max(F.col("h") > 58).over(W.partitionBy(F.expr("x0 div 50"), F.expr("y0 div 50"))).alias("tower_cell"))


@query("SELECT l_orderkey, max(l_quantity) AS most, arg_min(l_shipdate, (l_linenumber, l_partkey, l_shipdate)) AS first_date, count(*) AS pieces FROM lineitem GROUP BY 1")
def dissolve(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_shipdate", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("most"), F.min_by("l_shipdate", F.struct("l_linenumber", "l_partkey", "l_shipdate")).alias("first_date"), F.count("*").alias("pieces")
    )


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS total, max(l_partkey) OVER w AS top, count(*) OVER w AS size,
first_value(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS flag
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def group_broadcast(spark, sf_dir):
    w = W.partitionBy("l_orderkey")
    whole = w.orderBy("l_linenumber", "l_partkey", "l_returnflag").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_returnflag")
    flag = F.first(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), ignorenulls=True).over(whole)
    return df.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("total"), F.max("l_partkey").over(w).alias("top"), F.count("*").over(w).alias("size"), flag.alias("flag"))


@query("SELECT l_suppkey AS slot, CAST(sum(l_partkey) AS BIGINT) AS total, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY 1")
def scatter_reduce(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy(F.col("l_suppkey").alias("slot")).agg(
        F.sum("l_partkey").alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n")
    )


@query("""SELECT user_id, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
quantile_cont(value, 0.9) - quantile_cont(value, 0.1) < 100 AS flat FROM events GROUP BY 1""")
def zonal_percentiles(spark, sf_dir):
    p = A.quantiles(read(spark, sf_dir, "events", "user_id", "value"), "user_id", "value", p10=0.1, p50=0.5, p90=0.9)
    return p.select("user_id", *[F.round(n, 6).alias(n) for n in ("p10", "p50", "p90")], (F.col("p90") - F.col("p10") < 100).alias("flat"))


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC, l_linenumber) AS r, sum(k) OVER (PARTITION BY l_suppkey) AS n FROM c)
SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS mode, CAST(n AS BIGINT) AS n FROM m WHERE r = 1 AND n >= 20 AND k >= 0.15 * n""")
def mode_support(spark, sf_dir):
    return A.supported_mode(read(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber"), "l_suppkey", F.col("l_linenumber").cast("long"), 20, 0.15)


@query("""WITH c AS (SELECT l_orderkey // 8 AS cell, l_linestatus || l_returnflag AS cls, count(*) AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k DESC, cls) AS n FROM c) SELECT cell, cls FROM r WHERE n = 1""")
def majority_downsample(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag").groupBy(F.expr("l_orderkey div 8").alias("cell"), F.concat("l_linestatus", "l_returnflag").alias("cls")).agg(F.count("*").alias("k"))
    return c.groupBy("cell").agg(F.min_by("cls", F.struct(-F.col("k"), F.col("cls"))).alias("cls"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8")
def top_values(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_brand", "p_type").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types")).orderBy(F.desc("n"), "p_brand").limit(8)


@query(f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, n ORDER BY h DESC, id) AS k FROM a), w AS (SELECT * FROM r WHERE k = 1)
SELECT src, count(*) FILTER (h >= 20) AS over20, count(*) FILTER (h >= 40) AS over40, count(*) AS buildings FROM w GROUP BY 1""")
def pieces_vs_buildings(spark, sf_dir):
    whole = S.distinct_first(footprints(spark, sf_dir), ["kind", "n"], F.desc("h"), "id")
    return whole.groupBy("src").agg(F.count(F.when(F.col("h") >= 20, 1)).alias("over20"), F.count(F.when(F.col("h") >= 40, 1)).alias("over40"), F.count("*").alias("buildings"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 3) AS F, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 3) AS O FROM lineitem GROUP BY 1")
def pivot_km(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")
    return p.select("l_returnflag", F.round("F", 3).alias("F"), F.round("O", 3).alias("O"))


@query("""SELECT 'l_quantity' AS name, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS high FROM lineitem""")
def describe(spark, sf_dir):
    q = F.col("l_quantity")
    d = read(spark, sf_dir, "lineitem", "l_quantity").agg(F.count(q).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("low"), F.percentile(q, 0.25).alias("q25"), F.percentile(q, 0.5).alias("q50"), F.percentile(q, 0.75).alias("q75"), F.max(q).alias("high"))
    return d.select(F.lit("l_quantity").alias("name"), "*")


@query(f"{WITH} SELECT src, kind, count(*) AS n, CAST(grouping(src) * 2 + grouping(kind) AS BIGINT) AS level FROM a GROUP BY ROLLUP (src, kind)")
def rollup_counts(spark, sf_dir):
    return footprints(spark, sf_dir).rollup("src", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# --- windows ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS cum, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")
def running_total(spark, sf_dir):
    w = W.partitionBy("l_orderkey")
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return df.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("l_quantity").over(w).alias("total"))


@query(f"{WITH} SELECT id, CAST(row_number() OVER (PARTITION BY x0 // 250, y0 // 250 ORDER BY h DESC, id) AS BIGINT) AS rank FROM a")
def rank_in_tile(spark, sf_dir):
    w = W.partitionBy(F.expr("x0 div 250"), F.expr("y0 div 250")).orderBy(F.desc("h"), "id")
    return footprints(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("rank"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def first_last(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return read(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("""WITH s AS (SELECT user_id, event_id, event_id * 7 % 100 AS x, event_id * 13 % 100 AS y FROM events), d AS (SELECT *, (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 AS d2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(coalesce(d2, 0) AS BIGINT) AS d2, round(sum(sqrt(coalesce(d2, 0))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS along FROM d""")
def lag_chords(spark, sf_dir):
    s = read(spark, sf_dir, "events", "user_id", "event_id").selectExpr("user_id", "event_id", "event_id * 7 % 100 as x", "event_id * 13 % 100 as y")
    w = W.partitionBy("user_id").orderBy("event_id")
    step = lambda c: (F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w))
    d = s.withColumn("d2", F.coalesce(step("x") + step("y"), F.lit(0)))
    return d.select("user_id", "event_id", "d2", F.round(F.sum(F.sqrt("d2")).over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("along"))


ISLANDS = """WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w = 1 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)"""


@query(f"{ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY 1, 2")
def islands_merge(spark, sf_dir):
    runs = A.islands(read(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""{ISLANDS}, e AS (SELECT user_id, max(island) AS last, arg_min(event_type, island) AS a, arg_max(event_type, island) AS b FROM i GROUP BY 1)
SELECT user_id, CAST(CASE WHEN island = last AND a = b THEN 1 ELSE island END AS BIGINT) AS island, count(*) AS n FROM i JOIN e USING (user_id) GROUP BY 1, 2""")
def cyclic_runs(spark, sf_dir):
    runs = A.cyclic_islands(read(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"))


def smoothing(rounds: int, least: float) -> str:
    """SQL of the rounds, each as four steps."""
    by = "PARTITION BY user_id ORDER BY event_id"
    steps = ["t0 AS (SELECT user_id, event_id, event_type, 1.0::DOUBLE + event_id % 5 AS length, event_type AS s FROM events)"]
    for k in range(rounds):
        steps += [
            f"a{k} AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER ({by}) OR row_number() OVER ({by}) = 1 THEN 1 ELSE 0 END AS edge FROM t{k})",
            f"b{k} AS (SELECT *, sum(edge) OVER ({by} ROWS UNBOUNDED PRECEDING) AS run FROM a{k})",
            f"c{k} AS (SELECT *, sum(length) OVER (PARTITION BY user_id, run) AS total, max(run) OVER (PARTITION BY user_id) AS runs, max(CASE WHEN run = 2 THEN s END) OVER (PARTITION BY user_id) AS other FROM b{k})",
            f"t{k + 1} AS (SELECT user_id, event_id, event_type, length, CASE WHEN runs = 1 THEN s ELSE coalesce(last_value(CASE WHEN total >= {least} THEN s END IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING), other) END AS s FROM c{k})",
        ]
    return f"WITH {', '.join(steps)} SELECT user_id, event_id, event_type, length, s AS smoothed FROM t{rounds}"


@query(smoothing(3, 6.0))
def smooth_runs(spark, sf_dir):
    runs = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumn("length", F.expr("1.0D + event_id % 5"))
    return A.smooth_runs(runs, "user_id", "event_id", "event_type", "length", 6.0)


@query("SELECT l_orderkey, l_linenumber, l_partkey - coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 0) AS step FROM lineitem")
def delta_encode(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return df.select("l_orderkey", "l_linenumber", A.delta(df, "l_partkey", "l_orderkey", ["l_linenumber", "l_partkey"]).alias("step"))


@query(f"{WITH}, {hilbert_sql('a', 'x0 * 256 // 1000', 'y0 * 256 // 1000')} SELECT id, place FROM hilbert")
def hilbert_order(spark, sf_dir):
    return footprints(spark, sf_dir).select("id", hilbert("x0 * 256 div 1000", "y0 * 256 div 1000").alias("place"))


# --- top-k and sets ---------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT a.id AS a_id, b.id AS b_id, abs(a.h - b.h) AS diff FROM a JOIN b ON {MEET} ORDER BY diff DESC, a_id, b_id LIMIT 30")
def topk_disagreement(spark, sf_dir):
    return S.most_apart(footprints(spark, sf_dir), outlines(spark, sf_dir), 30)


@query(f"{WITH} SELECT CAST(x0 // 250 AS BIGINT) AS cx, CAST(y0 // 250 AS BIGINT) AS cy, count(*) AS n, round(avg(h), 6) AS mean FROM a GROUP BY 1, 2 HAVING count(*) >= 50 ORDER BY avg(h) DESC, cx, cy LIMIT 8")
def worst_cells(spark, sf_dir):
    g = A.grid(footprints(spark, sf_dir), 250, F.count("*").alias("n"), F.avg("h").alias("m"), x="x0", y="y0").where("n >= 50")
    return g.orderBy(F.desc("m"), "cx", "cy").limit(8).select("cx", "cy", "n", F.round("m", 6).alias("mean"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY (l_orderkey * 7919 + l_linenumber * 104729) % 100003, l_orderkey, l_linenumber LIMIT 500")
def seeded_sample(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return df.orderBy(F.expr("(l_orderkey * 7919 + l_linenumber * 104729) % 100003"), "l_orderkey", "l_linenumber").limit(500)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n = 1""")
def lexsort_first(spark, sf_dir):
    df = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return S.distinct_first(df, ["o_custkey"], "o_orderpriority", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"{WITH} SELECT id, h, src, NULL::VARCHAR AS use FROM a UNION ALL SELECT id, h, NULL, use FROM b")
def union_missing(spark, sf_dir):
    return footprints(spark, sf_dir).select("id", "h", "src").unionByName(outlines(spark, sf_dir).select("id", "h", "use"), allowMissingColumns=True)


@query(f"{WITH}, u AS (SELECT id, h, 1 AS d FROM a UNION ALL SELECT id, h, 2 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM u) SELECT id, h, CAST(d AS BIGINT) AS district FROM r WHERE n = 1")
def concat_first(spark, sf_dir):
    u = footprints(spark, sf_dir).select("id", "h", F.lit(1).alias("d")).unionAll(outlines(spark, sf_dir).select("id", "h", F.lit(2).alias("d")))
    return S.distinct_first(u, ["id"], "d").select("id", "h", F.col("d").cast("long").alias("district"))


@query("SELECT c_custkey AS id, 'extra' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'missing' FROM orders WHERE o_custkey % 1400 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def id_difference(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer", "c_custkey"), read(spark, sf_dir, "orders", "o_custkey")
    extra = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.lit("extra").alias("state"))
    even = c.where("c_custkey % 2 = 0")
    missing = o.join(even, F.col("o_custkey") % 1400 == F.col("c_custkey"), "left_anti").select(F.col("o_custkey").alias("id"), F.lit("missing").alias("state")).distinct()
    return extra.unionAll(missing)


@query("SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def key_intersect(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("key")).intersect(read(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45").select("l_partkey"))
