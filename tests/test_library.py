"""Properties of operators, sources, sinks and streams that SQL can't show."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.functions import tags
from cityloom.operators import aggregate, fuse, network, package, raster, spatial
from cityloom.sources import paged, settings, sinks, vector
from cityloom.streaming import refresh


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(1)
    rows = [(k, x := rng.randint(0, 90), y := rng.randint(0, 90), x + rng.randint(1, 15), y + rng.randint(1, 15)) for k in range(150)]
    return rows, spark.createDataFrame(rows, "id long, x0 long, y0 long, x1 long, y1 long")


@pytest.mark.parametrize("cell", [3, 10, 64])
@pytest.mark.parametrize("interior", [True, False])
def test_pairs_dont_depend_on_cells(boxes, cell, interior):
    rows, df = boxes
    got = {(r["a_id"], r["b_id"]) for r in spatial.self_pairs(df, cell, interior).select("a_id", "b_id").collect()}
    meet = (lambda p, q, r, s: p < s and r < q) if interior else (lambda p, q, r, s: p <= s and r <= q)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a[1], a[3], b[1], b[3]) and meet(a[2], a[4], b[2], b[4])}
    assert got == want


def test_pairs_come_once(boxes):
    _, df = boxes
    pairs = spatial.box_pairs(df, df, 5, within=4).select("a_id", "b_id")
    assert pairs.count() == pairs.distinct().count()


def test_join_plan_has_no_nested_loop(spark, boxes):
    plan = spatial.box_pairs(boxes[1], boxes[1])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_union_area():
    rng = np.random.default_rng(2)
    b = rng.integers(0, 20, (30, 4))
    b = np.column_stack([b[:, 0], b[:, 1], b[:, 0] + 1 + b[:, 2], b[:, 1] + 1 + b[:, 3]]).astype(float)
    squares = {(x, y) for x0, y0, x1, y1 in b.astype(int) for x in range(x0, x1) for y in range(y0, y1)}
    assert spatial.union_area_of(b) == len(squares)


def test_greedy_is_the_sequential_one(spark):
    rng = random.Random(3)
    rows = [(p, b, float(rng.randint(0, 30))) for p in range(25) for b in range(25) if rng.random() < 0.3]
    got = {(r["p"], r["b"]) for r in spatial.greedy_pairs(spark.createDataFrame(rows, "p long, b long, score double")).collect()}
    want, ps, bs = set(), set(), set()
    for s, p, b in sorted((s, p, b) for p, b, s in rows):
        if p not in ps and b not in bs:
            want.add((p, b))
            ps.add(p)
            bs.add(b)
    assert got == want


def test_greedy_leaves_no_candidate_open(spark):
    copies = [(p, b, 1.0) for p in range(100) for b in range(120)]
    chain = [(1000 + k, 1000 + b, 1.0) for k in range(70) for b in range(max(0, k - 1), k + 1)]
    got = {(r["p"], r["b"]) for r in spatial.greedy_pairs(spark.createDataFrame(copies + chain, "p long, b long, score double")).collect()}
    assert got == {(k, k) for k in range(100)} | {(1000 + k, 1000 + k) for k in range(70)}


def test_greedy_with_copies_is_the_sequential_one(spark):
    rng = random.Random(4)
    kinds = [[(b, float(rng.randint(0, 3))) for b in range(30) if rng.random() < 0.5] for _ in range(6)]
    rows = [(p, b, s) for p in range(40) for b, s in kinds[p % 6]]
    got = {(r["p"], r["b"]) for r in spatial.greedy_pairs(spark.createDataFrame(rows, "p long, b long, score double")).collect()}
    want, ps, bs = set(), set(), set()
    for _, p, b in sorted((s, p, b) for p, b, s in rows):
        if p not in ps and b not in bs:
            want.add((p, b))
            ps.add(p)
            bs.add(b)
    assert got == want


def test_smoothing(spark):
    def smoothed(types, lengths, least):
        df = spark.createDataFrame([(1, k, t, float(x)) for k, (t, x) in enumerate(zip(types, lengths, strict=True))], "key int, place int, type string, length double")
        return "".join(r["smoothed"] for r in aggregate.smooth_runs(df, "key", "place", "type", "length", least).orderBy("place").collect())

    assert smoothed("aabaaa", [5, 5, 1, 5, 5, 5], 3) == "aaaaaa"
    assert smoothed("baaa", [1, 5, 5, 5], 3) == "aaaa"
    assert smoothed("aa", [1, 1], 9) == "aa"
    assert smoothed("bacab", [1, 2, 9, 1, 7], 5) == "ccccb"  # aaccb after one round


def test_rules(spark):
    df = spark.createDataFrame([(1, None, 10.0, "osm", "X"), (2, 30.0, 100.0, "osm", "abc")], "id long, h double, area double, src string, kind string")
    rules = [fuse.Rule("drop", limits={"h_below": 5}), fuse.Rule("roof", "r", field="kind", values=("ABC",))]
    got = {r["id"]: r for r in fuse.ruled(df, rules).collect()}
    assert got[1]["dropped"] and got[2]["rule"] == "r" and got[2]["h_exact"] and not got[2]["dropped"]


def test_tags(spark):
    df = spark.createDataFrame([("103'",), ("12'6\"",), ("37;35",), ("12,5 m",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(tags.height_m(F.col("v"))).collect()]
    assert got[2:] == [37.0, 12.5, None, None] and abs(got[0] - 31.3944) < 1e-9 and abs(got[1] - 3.81) < 1e-9


def test_network_on_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(n)], "a long, b long, length double")
    nodes = spark.range(n + 3).select("id")
    got = {r["id"]: r["component"] for r in network.component_ids(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and got[n + 1] == n + 1
    start = nodes.where(f"id <= {n}").select("id", F.when(F.col("id") == 0, 0.0).otherwise(100.0).alias("h"))
    h = {r["id"]: r["h"] for r in network.lower_envelope(start, edges, 0.5).collect()}
    assert all(abs(h[k] - 0.5 * k) < 1e-9 for k in range(n + 1))


def test_network_on_a_long_path(spark):
    n = 230
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(n)], "a long, b long, length double")
    start = spark.range(n + 1).select("id", F.when(F.col("id") == 0, 0.0).otherwise(1000.0).alias("h"))
    h = {r["id"]: r["h"] for r in network.lower_envelope(start, edges, 0.5).collect()}
    assert all(abs(h[k] - 0.5 * k) < 1e-9 for k in range(n + 1))
    with pytest.raises(RuntimeError):
        network.lower_envelope(start.where("id < 4"), edges.where("b < 4"), -0.5)


def test_grade_line_is_the_dense_solve(spark):
    rng = random.Random(5)
    n, pull = 60, 1e-5
    pairs = [(k, k + 1) for k in range(39)] + [(rng.randint(0, 38), rng.randint(0, 38)) for _ in range(8)] + [(k, k + 1) for k in range(45, 55)]
    rows = [(a, b, rng.choice([0.5, 2.0, 30.0])) for a, b in pairs]
    ground, pinned = [float(rng.randint(0, 90)) for _ in range(n)], [k in (0, 39) for k in range(n)]
    m, rhs = np.diag([pull] * n), pull * np.array(ground)
    for a, b, length in rows:
        if a != b:
            w = 1 / max(length, 1)
            m[a, a], m[b, b], m[a, b], m[b, a] = m[a, a] + w, m[b, b] + w, m[a, b] - w, m[b, a] - w
    for k in (0, 39):
        m[k], rhs[k] = np.eye(n)[k], ground[k]
    want = np.linalg.solve(m, rhs)
    nodes = spark.createDataFrame([(k, ground[k], pinned[k]) for k in range(n)], "id long, ground double, pinned boolean")
    edges = spark.createDataFrame(rows, "a long, b long, length double")
    for direct in (500, 20):
        got = {r["id"]: r["v"] for r in network.grade_line(nodes, edges, direct=direct).collect()}
        assert len(got) == n and max(abs(got[k] - want[k]) for k in range(n)) < 1e-5
    with pytest.raises(RuntimeError):
        network.grade_line(nodes, edges, direct=20, rounds=3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_masses_of_all_footprints(spark, sf):
    from cityloom.plans import entities, registry

    rows = sorted(tuple(r) for r in entities.footprints(spark, f"/root/testdata/{sf}").select("id", "x0", "y0", "x1", "y1").collect())
    i, x0, y0, x1, y1 = np.array(rows).T
    meet = (x0 - 6 <= x1[:, None]) & (x0[:, None] - 6 <= x1) & (y0 - 6 <= y1[:, None]) & (y0[:, None] - 6 <= y1)
    want, open_ = set(), np.ones(len(i), bool)
    for k in range(len(i)):
        if open_[k]:
            held, n = np.arange(len(i)) == k, 0
            while held.sum() > n:
                n, held = held.sum(), meet[held].any(0)
            want.add((i[k], n, x0[held].min(), x1[held].max()))
            open_ &= ~held
    got = {tuple(r) for r in registry.QUERIES["merged_masses"](spark, f"/root/testdata/{sf}").select("id", "parts", "x0", "x1").collect()}
    assert got == want and sum(r[1] for r in got) == len(rows)


def test_tin_height_keeps_the_points_on_edges(spark):
    from cityloom.plans import layers

    points = spark.createDataFrame([(1, 0, 0), (2, 50, 50), (3, 100, 20), (4, 30, 20), (5, 7, 150)], "id long, x long, y long")
    h = lambda x, y: (x * 7 + y * 3) % 97
    got = {r["id"]: r["v"] for r in layers.heights(spark, points).collect()}
    want = {1: h(0, 0), 2: h(50, 50), 3: 0.6 * h(100, 0) + 0.4 * h(100, 50), 4: 0.6 * h(50, 0) + 0.4 * h(0, 50), 5: 0.86 * h(0, 150) + 0.14 * h(50, 150)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mosaic_and_opening(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 0, None)], "i long, j long, v double")
    b = spark.createDataFrame([(1, 0, 5.0), (0, 0, 9.0)], "i long, j long, v double")
    assert {(r.i, r.v) for r in raster.mosaic([a, b]).collect()} == {(0, 1.0), (1, 5.0)}
    spike = spark.createDataFrame([(i, j, 9.0 if (i, j) == (3, 3) else 1.0) for i in range(7) for j in range(7)], "i long, j long, v double")
    assert {r.v for r in raster.opened(spike, 1).collect()} == {1.0}


def test_settings():
    base = {"a": {"x": 1, "y": [1]}, "t": [{"k": 1}]}
    assert settings.merged(base, {"a": {"y": [2]}, "t": [{"k": 2}]}) == {"a": {"x": 1, "y": [2]}, "t": [{"k": 2}]}
    assert settings.merged(base, {"t": [{"k": 2}]}, append=True)["t"] == [{"k": 1}, {"k": 2}]
    presets = {"p": {"base": "q", "replace": ["a"], "a": {"z": 3}}, "q": {"a": {"x": 1}, "b": "{name}!"}}
    out = settings.resolve({"d": 1}, {"preset": "p", "name": "N", "utm_epsg": 1, "districts": {}}, presets.get)
    assert out["a"] == {"z": 3} and out["b"] == "N!" and out["d"] == 1
    with pytest.raises(ValueError):
        settings.resolve({}, {"name": "N"}, presets.get)


def test_stage_order():
    needs = {"a": [], "c": ["b"], "b": ["a"], "d": ["c"]}
    assert package.stage_order(needs) == ["a", "b", "c", "d"] and package.stage_order(needs, "b", "d", ("c",)) == ["b", "d"]
    with pytest.raises(ValueError):
        package.stage_order({"a": ["b"], "b": ["a"]})


def test_map_elements(spark, tmp_path):
    ring = [{"lon": x, "lat": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))]
    (tmp_path / "ok.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"building": "yes"}, "geometry": ring}, {"type": "way", "id": 6, "geometry": ring[:2]}]}))
    got = {r["osm_id"]: r["closed"] for r in vector.map_elements(spark, str(tmp_path / "ok.json")).collect()}
    assert got == {"w5": True, "w6": False}
    (tmp_path / "bad.json").write_text(json.dumps({"elements": [], "remark": "runtime error: timed out"}))
    with pytest.raises(Exception, match="answer failed"):
        vector.map_elements(spark, str(tmp_path / "bad.json")).collect()


def test_features_and_expressions(spark, tmp_path):
    square = lambda s: {"type": "Polygon", "coordinates": [[[0, 0], [s, 0], [s, s], [0, s], [0, 0]]]}
    rows = [({"fid": 1, "tall": "O", "hmed": 9.0, "hmax": 15.0}, square(2)), ({"fid": 2, "tall": "N", "hmed": 20.0, "hmax": 30.0}, square(3)), ({"fid": 3, "tall": "X", "hmed": 1.0, "hmax": 1.0}, square(1))]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in rows]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    df = vector.with_box(vector.features(spark, str(tmp_path / "f.json"), "fid: int, tall: string, hmed: double, hmax: double", drop={"tall": ["X"]}, rename={"fid": "id"}))
    h = vector.expression("where(tall == 'O', hmax, maximum(hmed, area))", df.columns)
    assert [(r["id"], r["h"], r["area"]) for r in df.withColumn("h", h).orderBy("id").collect()] == [(1, 15.0, 4.0), (2, 20.0, 9.0)]
    with pytest.raises(ValueError):
        vector.expression("__import__(tall)", df.columns)


def test_census(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿lon,lat,kind\n1.5,2.5,oak\nx,2,ash\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("at;kind\n\"3.5, 4.5\";elm\n", encoding="utf-8")
    a = vector.census(spark, [str(tmp_path / "a.csv")], columns=("kind",)).collect()
    b = vector.census(spark, [str(tmp_path / "b.csv")], sep=";", at="at", columns=("kind",)).collect()
    assert [(r.lon, r.lat, r.kind) for r in a + b] == [(1.5, 2.5, "oak"), (4.5, 3.5, "elm")]


def test_solids(spark, tmp_path):
    part = lambda name, z: f"<b:boundedBy><b:{name}><g:posList>0 0 {z} 1 0 {z} 1 1 {z + 2}</g:posList></b:{name}></b:boundedBy>"
    (tmp_path / "m.gml").write_text(f'<m xmlns:b="x" xmlns:g="y"><c><b:Building id="i1"><b:function>31</b:function><b:roofType>gable</b:roofType><b:measuredHeight>-9999</b:measuredHeight>{part("RoofSurface", 10)}{part("GroundSurface", 1)}</b:Building></c></m>')
    r = vector.solids(spark, str(tmp_path / "m.gml")).first()
    assert (r["gml_id"], r["function"], r["h"], r["roof_top_z"], r["eave_z"], r["ground_z"]) == ("i1", "31", None, 12.0, 10.0, 1.0)


def test_pages(spark, tmp_path):
    for at in (0, 2):
        (tmp_path / f"page-{at}.json").write_text(json.dumps({"features": [{"attributes": {"OBJECTID": at + k}} for k in range(2 if at == 0 else 1)]}))
    (tmp_path / "count.json").write_text('{"count": 3}')
    assert sorted(r["id"] for r in paged.paged(spark, str(tmp_path), 2).collect()) == [0, 1, 2]
    (tmp_path / "count.json").write_text('{"count": 4}')
    with pytest.raises(ValueError):
        paged.paged(spark, str(tmp_path), 2)
    assert paged.answer_key("a  b\n") == paged.answer_key("a b")


def test_tiles_round_trip(spark):
    rng = random.Random(7)
    rows = [(rng.randint(-500, 500) * 0.25, rng.randint(-500, 500) * 0.25, rng.randint(0, 255)) for _ in range(200)]
    points = spark.createDataFrame(rows, "x double, y double, code int")
    tiles = sinks.point_tiles(points, 100, 0.25)
    assert sorted(tuple(r) for r in sinks.decoded_tiles(tiles, 100, 0.25).collect()) == sorted(rows)
    assert "| n |" in sinks.report("t", points.groupBy().agg(F.count("*").alias("n")))


def test_stream_upsert(spark, tmp_path):
    schema = "id long, at long, v string"
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = refresh.feature_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, files=1)
    refresh.upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "id", "at").awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert sorted(tuple(r) for r in spark.read.parquet(str(last)).collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id % 30 as int)) as ts, id % 3 as k from range(90)").write.parquet(str(tmp_path / "e"))
    stream = refresh.feature_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    q = refresh.windowed_counts(stream, "ts", "10 minutes", "0 seconds", "k").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n), count(*) from w").first()[:2] == (90, 9)
    assert refresh.first_seen(stream, "ts", "1 hour", "k").isStreaming


def test_projection(spark):
    from cityloom.functions.geometry import utm

    df = spark.createDataFrame([(3.0, 0.0), (2.2945, 48.8583)], "lon double, lat double")
    x, y = utm(F.col("lon"), F.col("lat"), 31)
    (a, b) = df.select(x, y).collect()
    assert abs(a[0] - 500_000) < 1e-3 and abs(a[1]) < 1e-3
    assert abs(b[0] - 448_252) < 10 and abs(b[1] - 5_411_943) < 20


def test_polygons():
    from cityloom.functions import geometry as G

    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    ell = np.array([[1, 1], [9, 1], [9, 3], [3, 3], [3, 9], [1, 9]], float)
    assert G.shoelace(square) == 16 and abs(G.shoelace(G.clipped(ell, square))) == 3 * 3 - 1
    assert G.clipped(square + 100, square).size == 0
    assert G.holds(ell, np.array([[2, 8], [8, 8], [8, 2]], float)).tolist() == [True, False, True]
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    length, width = G.least_rectangle(np.array([[0, 0], [7, 0], [7, 2], [0, 2], [3, 1]], float) @ turn)
    assert abs(length - 7) < 1e-9 and abs(width - 2) < 1e-9
