"""Tiles, offsets, staleness, comparison of datasets, and order of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tile(x: Column, y: Column, size: float, origin: tuple[float, float] = (0, 0)) -> list[Column]:
    return [F.floor((c - o) / size).cast("long").alias(n) for c, o, n in ((x, origin[0], "tx"), (y, origin[1], "ty"))]


def block_offsets(parts: DataFrame, block: str, order: list[str], length: str) -> DataFrame:
    """parts with `offset`: where each starts in its block."""
    before = W.partitionBy(block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def stale(outputs: DataFrame, inputs: DataFrame, slack: float = 1.0) -> DataFrame:
    """name, by: outputs (name, made) older than the newest of their inputs (name, changed) by more than `slack` seconds."""
    newest = inputs.groupBy("name").agg(F.max("changed").alias("changed"))
    return outputs.join(newest, "name").withColumn("by", F.col("changed") - F.col("made")).where(F.col("by") > slack).select("name", "by")


def differences(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """key, state: extra (only in a), missing (only in b) or changed; nulls and NaN equal themselves, floating point has a tolerance."""
    columns = [c for c in a.columns if c != key and c in b.columns]
    types = dict(a.dtypes)
    same = F.lit(True)
    for c in columns:
        x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
        close = F.abs(x - y) <= tolerance if types[c] in ("double", "float") else F.lit(False)
        same &= x.eqNullSafe(y) | F.coalesce(close, F.lit(False))
    met = a.withColumn("_x", F.lit(1)).alias("x").join(b.withColumn("_y", F.lit(1)).alias("y"), key, "full")
    state = F.when(F.col("_y").isNull(), "extra").when(F.col("_x").isNull(), "missing").when(~same, "changed")
    return met.select(key, state.alias("state")).where("state is not null")


def stage_order(needs: dict[str, list[str]], first: str | None = None, last: str | None = None, skip: tuple[str, ...] = ()) -> list[str]:
    """Stages after what they need, in the order given; from `first` to `last`, without those to skip."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"stages need each other: {' -> '.join([*path, name])}")
        if name not in out:
            for n in needs[name]:
                visit(n, (*path, name))
            out.append(name)

    for name in needs:
        visit(name, ())
    begin, end = out.index(first) if first else 0, out.index(last) + 1 if last else len(out)
    return [x for x in out[begin:end] if x not in skip]
