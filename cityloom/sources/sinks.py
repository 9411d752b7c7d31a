"""Sinks: layers by tile, tile bodies as bytes with an index, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.functions.shapes import split_bytes

#: Decoded points of a batch.
ROWS = 100_000


def write_layer(df: DataFrame, path: str, *tile: str) -> None:
    """Parquet in a folder a tile; a tile's rows come from few tasks, so that its files are few."""
    df.repartition(*tile).write.mode("overwrite").partitionBy(*tile).parquet(path)


def point_tiles(points: DataFrame, size: float, quantum: float) -> DataFrame:
    """points (x, y, code) -> tx, ty, n, body: places in units of the quantum, sorted, as differences, low bytes before high ones."""
    tile = [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in (("x", "tx"), ("y", "ty"))]
    place = [F.round((F.col(c) - F.floor(F.col(c) / size) * size) / quantum).cast("int").alias(n) for c, n in (("x", "qx"), ("y", "qy"))]
    rows = points.select(*tile, *place, F.col("code").cast("int").alias("code"))
    g = rows.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("qx", "qy", "code"))).alias("p"))
    column = lambda c: F.transform("p", lambda v: v[c])
    before = lambda c: F.concat(F.array(F.lit(0)), F.slice(column(c), F.lit(1), F.size("p") - 1))
    steps = lambda c: F.zip_with(column(c), before(c), lambda v, last: v - last)
    return g.select("tx", "ty", "n", F.concat(split_bytes(steps("qx")), split_bytes(steps("qy")), split_bytes(column("code"))).alias("body"))


def decoded_tiles(tiles: DataFrame, size: float, quantum: float) -> DataFrame:
    """The points of point_tiles, back again."""

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tx, ty, n, body in batch.itertuples(index=False):
                code = np.frombuffer(body, np.uint8).reshape(3, 2, n).astype("int32")
                qx, qy, code = code[:, 0] + 256 * code[:, 1]
                place = [np.cumsum(q - (q >= 32768) * 65536) for q in (qx, qy)]
                for k in range(0, n, ROWS):
                    yield pd.DataFrame({"tx": tx, "ty": ty, "qx": place[0][k : k + ROWS], "qy": place[1][k : k + ROWS], "code": code[k : k + ROWS]})

    p = tiles.select("tx", "ty", F.col("n").cast("int"), "body").mapInPandas(points, "tx long, ty long, qx int, qy int, code int")
    return p.select((F.col("tx") * size + F.col("qx") * quantum).alias("x"), (F.col("ty") * size + F.col("qy") * quantum).alias("y"), "code")


def report(title: str, df: DataFrame, most: int = 200) -> str:
    """A table of an aggregate, as Markdown."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows), ""])
