"""Connected components of a graph given as edges, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.common import released, settled


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs -> (id, component), a row for each end: equal components for connected ends.

    Each round every end takes the lowest-ranked end among itself and its neighbours, by a rank that is hashed anew, edges
    are renamed and loops dropped. That removes a constant share of the ends on average whatever the graph's shape, so the
    rounds grow with the logarithm of its size. Nothing but a count reaches the driver; each round is a settled table.
    """
    levels: list[DataFrame] = []
    edges = settled(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    while edges.take(1):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64(F.lit(len(levels)), F.col("b"))
        low = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("id"))).alias("low"))
        own = F.struct(F.xxhash64(F.lit(len(levels)), F.col("a")).alias("r"), F.col("a").alias("id"))
        level = settled(low.select(F.col("a").alias("id"), F.least("low", own)["id"].alias("to")), "level")
        levels.append(level)
        left = level.select(F.col("id").alias("a"), F.col("to").alias("_a"))
        right = level.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        renamed = edges.join(left, "a").join(right, "b").where("_a <> _b")
        fewer = settled(renamed.selectExpr("least(_a, _b) as a", "greatest(_a, _b) as b").distinct(), "edges")
        released(edges)
        edges = fewer
    out = None
    for level in reversed(levels):
        if out is None:
            out = level.select("id", F.col("to").alias("component"))
        else:
            after = out.select(F.col("id").alias("to"), "component")
            out = level.join(after, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    if out is None:
        out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out
