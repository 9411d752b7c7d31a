"""Boxes, points and tags derived from the plain tables by whole-number arithmetic, so that any engine gets the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from parts: id, x0, y0, x1, y1, h (height), src (source), kind, n (storeys)."""
    return read(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand").selectExpr(
        "p_partkey as id", "(p_partkey * 37) % 1000 as x0", "(p_partkey * 53) % 1000 as y0",
        "(p_partkey * 37) % 1000 + 1 + p_size as x1", "(p_partkey * 53) % 1000 + 5 + p_partkey % 17 as y1",
        "3 + (p_partkey * 7) % 60 as h", "if(p_partkey % 4 = 0, 'osm', if(p_partkey % 4 = 1, 'lidar', 'survey')) as src", "p_brand as kind", "1 + p_partkey % 20 as n",
    )


FOOTPRINTS = """SELECT p_partkey AS id, (p_partkey * 37) % 1000 AS x0, (p_partkey * 53) % 1000 AS y0,
    (p_partkey * 37) % 1000 + 1 + p_size AS x1, (p_partkey * 53) % 1000 + 5 + p_partkey % 17 AS y1,
    3 + (p_partkey * 7) % 60 AS h, CASE WHEN p_partkey % 4 = 0 THEN 'osm' WHEN p_partkey % 4 = 1 THEN 'lidar' ELSE 'survey' END AS src,
    p_brand AS kind, 1 + p_partkey % 20 AS n FROM part"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from customers: id, x0, y0, x1, y1, h, use."""
    return read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").selectExpr(
        "c_custkey as id", "(c_custkey * 41) % 1000 as x0", "(c_custkey * 59) % 1000 as y0",
        "(c_custkey * 41) % 1000 + 10 + c_nationkey as x1", "(c_custkey * 59) % 1000 + 10 + c_custkey % 13 as y1",
        "4 + (c_custkey * 11) % 50 as h", "c_mktsegment as use",
    )


OUTLINES = """SELECT c_custkey AS id, (c_custkey * 41) % 1000 AS x0, (c_custkey * 59) % 1000 AS y0,
    (c_custkey * 41) % 1000 + 10 + c_nationkey AS x1, (c_custkey * 59) % 1000 + 10 + c_custkey % 13 AS y1,
    4 + (c_custkey * 11) % 50 AS h, c_mktsegment AS use FROM customer"""


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from suppliers: id, x, y, h (listed height), name."""
    return read(spark, sf_dir, "supplier", "s_suppkey", "s_name").selectExpr(
        "s_suppkey as id", "(s_suppkey * 67) % 1000 as x", "(s_suppkey * 71) % 1000 as y", "5 + (s_suppkey * 13) % 70 as h", "s_name as name"
    )


LANDMARKS = """SELECT s_suppkey AS id, (s_suppkey * 67) % 1000 AS x, (s_suppkey * 71) % 1000 AS y,
    5 + (s_suppkey * 13) % 70 AS h, s_name AS name FROM supplier"""

#: Tables an oracle can begin with.
WITH = f"WITH a AS ({FOOTPRINTS}), b AS ({OUTLINES}), p AS ({LANDMARKS})"
