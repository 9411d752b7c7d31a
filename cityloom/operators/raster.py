"""Rasters as cell tables (i, j, v): absent cells have no data. Windows run along rows and then along columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def burned(boxes: DataFrame, cell: float, value: str, order: str) -> DataFrame:
    """i, j, v of the cells whose centres lie in boxes; of several the one that comes last in the order."""
    first = lambda c: F.ceil(F.col(c) / cell - 0.5)
    last = lambda c: F.ceil(F.col(c) / cell - 0.5) - 1
    wide = boxes.where((last("x1") >= first("x0")) & (last("y1") >= first("y0")))
    wide = wide.withColumn("i", F.explode(F.sequence(first("x0"), last("x1")))).withColumn("j", F.explode(F.sequence(first("y0"), last("y1"))))
    return wide.groupBy("i", "j").agg(F.max_by(value, order).alias("v"))


def _along(axis: str, reach: int) -> W:
    other = "j" if axis == "i" else "i"
    return W.partitionBy(other).orderBy(axis).rangeBetween(-reach, reach)


def filtered(cells: DataFrame, reach: int, how) -> DataFrame:
    """A separable filter (F.min, F.max) over squares of 2 * reach + 1 cells, as far as they have data."""
    for axis in "ij":
        cells = cells.withColumn("v", how("v").over(_along(axis, reach)))
    return cells


def opened(cells: DataFrame, reach: int) -> DataFrame:
    """Grey opening: the least and then the greatest of each square."""
    return filtered(filtered(cells, reach, F.min), reach, F.max)


def box_mean(cells: DataFrame, reach: int, rounds: int = 1) -> DataFrame:
    """Means of squares, cells without data counting as 0 inside the square's full size."""
    size = 2 * reach + 1
    for _ in range(rounds):
        for axis in "ij":
            cells = cells.withColumn("v", F.sum("v").over(_along(axis, reach)) / size)
    return cells


def mosaic(layers: list[DataFrame]) -> DataFrame:
    """The first layer's value where it has one, else the next one's."""
    out = None
    for n, layer in enumerate(layers):
        part = layer.where("v is not null").select("i", "j", "v", F.lit(n).alias("_n"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("i", "j").agg(F.min_by("v", "_n").alias("v"))


def bilinear(cells: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """points (id, x, y) with v, from the four cells whose centres are around; null where one of them has no data."""
    u, w = F.col("x") / cell - 0.5, F.col("y") / cell - 0.5
    p = points.withColumns({"_i": F.floor(u), "_j": F.floor(w)}).withColumns({"_a": u - F.col("_i"), "_b": w - F.col("_j")})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = p.withColumn("_c", corner).withColumns({"i": F.col("_i") + F.col("_c.a"), "j": F.col("_j") + F.col("_c.b")})
    share = F.when(F.col("_c.a") == 1, F.col("_a")).otherwise(1 - F.col("_a")) * F.when(F.col("_c.b") == 1, F.col("_b")).otherwise(1 - F.col("_b"))
    met = p.join(cells.select("i", "j", "v"), ["i", "j"]).groupBy("id").agg(F.sum(F.col("v") * share).alias("v"), F.count("*").alias("_n"))
    return points.select("id").join(met.where("_n = 4").drop("_n"), "id", "left")


def zonal(cells: DataFrame, boxes: DataFrame, cell: float, *aggregates: Column) -> DataFrame:
    """Aggregates of v over the cells whose centres lie in each box."""
    first = lambda c: F.ceil(F.col(c) / cell - 0.5)
    wide = boxes.select("id", F.explode(F.sequence(first("x0"), F.greatest(first("x0"), first("x1") - 1))).alias("i"), "y0", "y1")
    wide = wide.select("id", "i", F.explode(F.sequence(first("y0"), F.greatest(first("y0"), first("y1") - 1))).alias("j"))
    return wide.join(cells, ["i", "j"]).groupBy("id").agg(*aggregates)


def shares(cells: DataFrame, step: int) -> DataFrame:
    """i, j, v: the share of the step * step fine cells with v that each coarse cell has."""
    return cells.groupBy(F.floor(F.col("i") / step).alias("i"), F.floor(F.col("j") / step).alias("j")).agg((F.sum("v") / (step * step)).alias("v"))


def barycentric(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """points (id, x, y) with v on the triangles (t, ax, ay, av, bx, ...) that hold them, by cells; the least t of several, 0 outside."""
    lo = lambda c: F.floor(F.least(*[F.col(p + c) for p in "abc"]) / cell)
    hi = lambda c: F.floor(F.greatest(*[F.col(p + c) for p in "abc"]) / cell)
    spread = triangles.withColumn("_i", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_j", F.explode(F.sequence(lo("y"), hi("y"))))
    p = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    area = F.expr("(bx - ax) * (cy - ay) - (cx - ax) * (by - ay)")
    wb, wc = F.expr("(x - ax) * (cy - ay) - (cx - ax) * (y - ay)") / area, F.expr("(bx - ax) * (y - ay) - (x - ax) * (by - ay)") / area
    met = p.join(spread, ["_i", "_j"]).withColumns({"_b": wb, "_c": wc}).where("_b >= 0 and _c >= 0 and _b + _c <= 1")
    best = met.groupBy("id").agg(F.min_by(F.expr("av + _b * (bv - av) + _c * (cv - av)"), "t").alias("v"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))
