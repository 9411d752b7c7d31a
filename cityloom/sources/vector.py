"""Readers of vector sources: feature collections, map elements, censuses, record files, solids in XML. They all declare their
schema and push filters and column lists into the scan where the format can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lon: double, lat: double>"
ELEMENTS = (
    f"elements array<struct<type: string, id: bigint, tags: map<string, string>, nodes: array<bigint>, geometry: array<{POINT}>, "
    f"members: array<struct<type: string, role: string, geometry: array<{POINT}>>>>>, remark string"
)


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a map server, one JSON document a file -> a row an element: osm_id (w12, r3), tags, nodes, line, closed. An
    answer whose remark tells of an error is refused."""
    raw = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    failed = F.coalesce(F.lower("remark").rlike("error|timed out|timeout"), F.lit(False))
    answers = raw.withColumn("elements", F.when(failed, F.raise_error(F.concat(F.lit("answer failed: "), F.col("remark")))).otherwise(F.col("elements")))
    e = answers.select(F.explode("elements").alias("e")).select("e.*")
    ring = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    return e.select(
        F.concat(F.substring("type", 1, 1), F.col("id")).alias("osm_id"), "type", "tags", "nodes", F.col("geometry").alias("line"),
        F.coalesce((F.col("type") == "way") & ring, F.lit(False)).alias("closed"), "members",
    )


def features(spark: SparkSession, path: str, properties: str, *, rename: dict[str, str] | None = None, drop: dict[str, list] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A feature collection of polygons -> a row a feature: its properties (a schema string) and rings. One feature a line, or
    one document a file."""
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>"
    raw = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("_g")).where("_g.type = 'Polygon'")
    for name, values in (drop or {}).items():
        f = f.where(~F.coalesce(F.col(name).cast("string").isin([str(v) for v in values]), F.lit(False)))
    f = f.withColumnsRenamed(rename or {})
    return f.select(*(columns or [c for c in f.columns if c != "_g"]), F.col("_g.coordinates").alias("rings"))


def with_box(df: DataFrame, ring: str = "rings") -> DataFrame:
    """x0, y0, x1, y1 of the outer ring, and its area by the shoelace formula."""
    outer = F.element_at(ring, 1)
    xs, ys = F.transform(outer, lambda p: p[0]), F.transform(outer, lambda p: p[1])
    turn = F.aggregate(F.sequence(F.lit(1), F.size(outer) - 1), F.lit(0.0), lambda a, i: a + F.element_at(xs, i) * F.element_at(ys, i + 1) - F.element_at(xs, i + 1) * F.element_at(ys, i))
    return df.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys), "area": F.abs(turn) / 2})


def expression(text: str, columns: list[str]) -> Column:
    """A settings' expression over columns: where(a, b, c), maximum, minimum, isnan, abs, comparisons, and, or."""
    import re

    names = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", text)))
    known = {"where": "if", "maximum": "greatest", "minimum": "least", "isnan": "isnull", "abs": "abs", "and": "and", "or": "or", "not": "not"}
    if bad := names - set(columns) - set(known):
        raise ValueError(f"unknown names in an expression: {', '.join(sorted(bad))}")
    parts = re.split(r"('[^']*')", text)
    out = [p if k % 2 else re.sub(r"[A-Za-z_]\w*", lambda m: known.get(m[0], m[0]), p.replace("==", "=")) for k, p in enumerate(parts)]
    return F.expr("".join(out))


def census(spark: SparkSession, paths: list[str], *, sep: str = ",", at: str | None = None, lon: str = "lon", lat: str = "lat", columns: tuple[str, ...] = ()) -> DataFrame:
    """Points of several CSV files in turn: lon, lat (of two columns, or of one "lat, lon"), source (its number)."""
    out = None
    for n, path in enumerate(paths):
        raw = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8")
        raw = raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns})
        if at:
            pair = F.split(at, r"\s*,\s*")
            x, y = F.get(pair, 1), F.get(pair, 0)
        else:
            x, y = F.col(lon), F.col(lat)
        rows = raw.select(x.try_cast("double").alias("lon"), y.try_cast("double").alias("lat"), *columns, F.lit(n).alias("source")).where("lon is not null and lat is not null")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def records(spark: SparkSession, pattern: str) -> DataFrame:
    """Record files of a pattern, with a header; columns that a file lacks are null."""
    names = sorted(r["path"] for r in spark.read.format("binaryFile").load(pattern).select("path").collect())
    out = None
    for name in names:
        part = spark.read.csv(name, header=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def solids(spark: SparkSession, path: str, row_tag: str = "Building") -> DataFrame:
    """Buildings of an XML city model: gml_id, function, roof_type, h (no-data values of 9999 either way are null), and the roof's
    and the ground's heights from its position lists."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("attributePrefix", "_").schema(
        "_id string, function string, roofType string, measuredHeight double, boundedBy array<struct<RoofSurface: struct<posList: string>, GroundSurface: struct<posList: string>>>"
    ).load(path)
    z = lambda part: F.flatten(F.transform(F.filter(F.transform("boundedBy", lambda b: b[part]["posList"]), lambda s: s.isNotNull()), lambda s: F.transform(F.filter(F.transform(F.split(F.trim(s), r"\s+"), lambda v, i: F.when(i % 3 == 2, v.try_cast("double"))), lambda v: v.isNotNull()), lambda v: v)))
    h = F.when(F.abs(F.col("measuredHeight")) < 9999, F.col("measuredHeight"))
    return raw.select(F.col("_id").alias("gml_id"), "function", F.col("roofType").alias("roof_type"), h.alias("h"), F.array_max(z("RoofSurface")).alias("roof_top_z"), F.array_min(z("RoofSurface")).alias("eave_z"), F.array_min(z("GroundSurface")).alias("ground_z"))


def within_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float, box: str = "bbox") -> DataFrame:
    """Rows whose box column meets a box: comparisons of its leaves, which Parquet's row groups are pruned by."""
    return df.where((F.col(f"{box}.xmin") <= x1) & (F.col(f"{box}.xmax") >= x0) & (F.col(f"{box}.ymin") <= y1) & (F.col(f"{box}.ymax") >= y0))
