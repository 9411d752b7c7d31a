"""Networks as edge tables (a, b, length): relaxations in rounds that join and take minima, until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.operators.lineage import cut

#: Edges that are contracted at once, at least (a batch of Arrow's more at most).
LOT = 1 << 19


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumnsRenamed({"a": "_b", "b": "_a"}).withColumnsRenamed({"_b": "b", "_a": "a"}))


def lower_envelope(start: DataFrame, edges: DataFrame, grade: float) -> DataFrame:
    """start (id, h), edges (a, b, length) -> id, h: the least over all nodes of its h plus grade times the way to it."""
    ways, h = both_ways(edges).select("a", "b", "length"), cut(start.select("id", "h"))
    for _ in range(h.count() + 1):  # a least way has fewer steps than there are nodes
        over = h.join(ways, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("h") + grade * F.col("length")).alias("h"))
        low = over.groupBy("id").agg(F.min("h").alias("_over"))
        after = cut(h.join(low, "id", "left").select("id", F.least("h", F.coalesce("_over", "h")).alias("h"), (F.col("_over") < F.col("h")).alias("_fell")))
        if not after.where("_fell").take(1):
            return after.select("id", "h")
        h = after.select("id", "h")
    raise RuntimeError("not settled: a negative grade or length, or an id on two rows")


def least_of_each(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 the least one that the edges a - b connect: roots are hung on lesser ones, then all ways are halved."""
    low = np.arange(n)
    while len(a):
        p, q = low[a], low[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    return low


def contracted(edges: DataFrame) -> DataFrame:
    """id, low: each node of some edges that lie together, with the least that they connect it to. A node that several such lots hold has
    a row for each. Edges are in order of their ends, so that what is near is mostly in one lot."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def lot() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks])
            names = ends.unique()
            names = names.take(pc.sort_indices(names))  # places are in the order of ids
            at = pc.index_in(ends, names).to_numpy()
            low = least_of_each(at[: len(t)], at[len(t) :], len(names))
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(low))], ["id", "low"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= LOT:
                yield lot()
                held = []
        if held:
            yield lot()

    low = edges.select("a", "b").where("a is not null and b is not null")
    return low.repartitionByRange("a").sortWithinPartitions("a", "b").mapInArrow(run, f"id {kind}, low {kind}")


def component_ids(nodes: DataFrame, edges: DataFrame, together: bool = False, before: int | None = None) -> DataFrame:
    """id, component: the least id that the edges connect. What the edges of a lot connect is found in its task; between lots only
    the nodes that several hold go on, as edges between their lots' least ones: to lots again, or, where these are no less than half as
    many as the `before` edges, to fallen(). The ends of edges are among the nodes."""
    ends = cut(contracted(edges.select("a", "b")))
    first = ends.groupBy("id").agg(F.min("low").alias("a"), F.max("low").alias("_last"))
    more = cut(ends.join(first.where("a < _last").select("id", "a"), "id").where("a < low").select("a", F.col("low").alias("b")).distinct())
    out, n = first.select("id", F.col("a").alias("_low")), more.count()
    if n:
        lows = more.select(F.col("a").alias("id")).union(more.select("b")).distinct()
        up = fallen(lows, more, together) if before is not None and n * 2 > before else component_ids(lows, more, together, n)
        out = out.join(up.withColumnRenamed("id", "_low"), "_low", "left").select("id", F.coalesce("component", "_low").alias("_low"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("_low", "id").alias("component"))


def fallen(nodes: DataFrame, edges: DataFrame, together: bool = False) -> DataFrame:
    """id, component: the least id that the edges connect. Labels fall along the edges, and to their labels' labels, which
    halves the way each round. `together`: all nodes of a label fall as far as the first of them, which saves rounds where
    components are large and dense."""
    ways, label = cut(both_ways(edges).select("a", "b").distinct()), cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(label.count() + 1):  # a label moves a step a round, at least
        low = label.join(ways, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("_low"))
        near = label.join(low, "id", "left").select("id", "component", F.least("component", F.coalesce("_low", "component")).alias("_to"))
        if together:
            near = near.join(near.groupBy("component").agg(F.min("_to").alias("_all")), "component").select("id", "component", F.col("_all").alias("_to"))
        jump = near.select(F.col("id").alias("_to"), F.col("_to").alias("_far"))
        after = cut(near.join(jump, "_to", "left").select("id", F.least("_to", F.coalesce("_far", "_to")).alias("component"), (F.least("_to", F.coalesce("_far", "_to")) < F.col("component")).alias("_fell")))
        if not after.where("_fell").take(1):
            return after.select("id", "component")
        label = after.select("id", "component")
    raise RuntimeError("not settled: a negative grade or length, or an id on two rows")


def harmonic(pinned: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """id, v: nodes that aren't pinned take the mean of their neighbours by 1 / length, `rounds` times from 0."""
    ways = both_ways(edges).select("a", "b", (1 / F.col("length")).alias("w"))
    fixed = pinned.select("id", F.col("v").alias("_pin"))
    v = nodes.select("id").join(fixed, "id", "left").select("id", F.coalesce("_pin", F.lit(0.0)).alias("v"), "_pin")
    for n in range(rounds):
        mean = v.join(ways, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("_m"))
        v = v.join(mean, "id", "left").select("id", F.coalesce("_pin", "_m", "v").alias("v"), "_pin")
        if n % 5 == 4:
            v = cut(v)
    return v.select("id", "v")


def solved(part: pd.DataFrame) -> pd.DataFrame:
    """The free nodes of one component, by elimination."""
    at, m = {k: n for n, k in enumerate(part["id"])}, np.diag(part["d"].to_numpy(float))
    for n, near in enumerate(part["near"]):
        for x in near if near is not None else ():
            m[n, at[x["a"]]] -= x["w"]
    return pd.DataFrame({"id": part["id"], "v": part["v"] + np.linalg.solve(m, part["r"].to_numpy(float))})


def conjugate(state: DataFrame, ways: DataFrame, most_left: float, rounds: int) -> DataFrame:
    """state (id, v, r, d), ways (a, b, w) -> id, v: conjugate gradients with the diagonal, until no residual r is over most_left."""
    left = [F.sum(F.expr("r * r / d")), F.max(F.abs("r"))]
    state = cut(state.withColumn("p", F.expr("r / d")))
    norm, most = state.agg(*left).first()
    for _ in range(rounds):
        if most is None or most <= most_left:
            return state.select("id", "v")
        near = state.select(F.col("id").alias("a"), "p").join(ways, "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.expr("w * p")).alias("_near"))
        state = cut(state.join(near, "id", "left").withColumn("q", F.expr("d * p - coalesce(_near, 0)")).drop("_near"))
        step = norm / state.agg(F.sum(F.expr("p * q"))).first()[0]
        state = state.withColumns({"v": F.col("v") + step * F.col("p"), "r": F.col("r") - step * F.col("q")})
        after, most = state.agg(*left).first()
        state, norm = state.withColumn("p", F.expr("r / d") + after / norm * F.col("p")).drop("q"), after
    raise RuntimeError(f"not settled after {rounds} rounds")


def grade_line(nodes: DataFrame, edges: DataFrame, pull: float = 1e-5, direct: int = 500, tolerance: float = 1e-6, rounds: int = 5000) -> DataFrame:
    """nodes (id, ground, pinned), edges (a, b, length) -> id, v: the v that make the sum of (va - vb)^2 / length over the edges and
    of pull * (v - ground)^2 over the nodes least, pinned ones being at their ground. Lengths count as 1 at least. Pinned nodes
    part the rest into components; those of up to `direct` nodes are solved by elimination, larger ones by conjugate gradients
    until no residual is over tolerance * pull: no v is then further than the tolerance from the solution, as each row of the
    system exceeds its other entries by pull."""
    ends = lambda c: nodes.select(F.col("id").alias(c), F.col("ground").alias(f"{c}_at"), F.col("pinned").alias(f"{c}_pin"))
    ways = both_ways(edges).where("a <> b").groupBy("a", "b").agg(F.sum(1 / F.greatest("length", F.lit(1.0))).alias("w"))
    ways = cut(ways.join(ends("a"), "a").join(ends("b"), "b").where("not b_pin"))
    start = ways.groupBy(F.col("b").alias("id")).agg(F.sum("w").alias("_w"), F.sum(F.expr("w * (a_at - b_at)")).alias("_r"))
    ways, free = ways.where("not a_pin").select("a", "b", "w"), nodes.where("not pinned")
    label = component_ids(free.select("id"), ways.where("a < b").select("a", "b", F.col("w").alias("length")))
    sizes = label.groupBy("component").agg(F.count("*").alias("n"))
    free = free.join(start, "id", "left").join(label, "id").join(sizes, "component")
    free = cut(free.select("id", "component", "n", F.col("ground").alias("v"), F.coalesce("_r", F.lit(0.0)).alias("r"), (F.coalesce("_w", F.lit(0.0)) + pull).alias("d")))
    small, large = free.where(F.col("n") <= direct), free.where(F.col("n") > direct)
    near = ways.join(small.select(F.col("id").alias("b")), "b").groupBy(F.col("b").alias("id")).agg(F.collect_list(F.struct("a", "w")).alias("near"))
    out = small.join(near, "id", "left").groupBy("component").applyInPandas(solved, "id long, v double")
    if large.take(1):
        out = out.unionByName(conjugate(large.drop("component", "n"), ways, tolerance * pull, rounds))
    return out.unionByName(nodes.where("pinned").select("id", F.col("ground").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
