"""Op 6: near-duplicate embeddings by an inverted multi-index.

Vectors are cut in halves, each half gets a codebook of its own, and pairs of codewords form a grid of cells. A vector visits
the cells nearest to it in multi-sequence order (by the sum of its halves' distances to the codewords) and is compared, in
double precision, with the vectors that lie there. How many cells are visited is set on the sample that the codebooks are
fitted on (SAMPLE vectors at most): as many as find TARGET of the sample's own links and of links made by turning sample
vectors by just the similarity asked for. A pair is linked if either vector visits the other's cell.

Equal vectors are one node, however many there are. Cells of one first-half codeword are a work unit; members and visitors of
large units are dealt in chunks to more tasks, each pair of chunks to one, so a cell that holds a third of all vectors is no
single task's. Tasks return link counts, and of the links only a spanning forest for the components.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows without
vec_id; vectors of different lengths don't link; rows that repeat a vector (or a vec_id) count as other vectors; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import settled, table, tidy
from cityloom.llm.components import components

COSINE = 0.9
SAMPLE = 20_000
PAIRS = 2_000
TARGET = 0.995
PER_CELL = 48
MOST_WORDS = 256
MEMBERS, VISITORS = 2048, 8192


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k means, begun far apart."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1) -> None:
        self.first, self.second, self.visits = first, second, visits
        self.half = first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return distances(x[:, : self.half], self.first).argmin(1) * len(self.second) + distances(x[:, self.half :], self.second).argmin(1)

    def visited(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """Each vector's cells, nearest first. A cell among the first v has codewords of ranks i, j with (i + 1)(j + 1) <= v: only
        those are sorted, which is what the multi-sequence walk would pop."""
        visits = min(visits or self.visits, len(self.first) * len(self.second))
        a, b = distances(x[:, : self.half], self.first), distances(x[:, self.half :], self.second)
        ra, rb = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        ij = np.array([(i, j) for i in range(min(visits, a.shape[1])) for j in range(min(visits // (i + 1), b.shape[1]))])
        sums = np.take_along_axis(a, ra[:, ij[:, 0]], 1) + np.take_along_axis(b, rb[:, ij[:, 1]], 1)
        best = np.argsort(sums, 1, kind="stable")[:, :visits]
        rows = np.arange(len(x))[:, None]
        return ra[rows, ij[best, 0]] * len(self.second) + rb[rows, ij[best, 1]]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def fitted(sample: np.ndarray, n: int, cosine: float) -> Grid:
    """The grid for n vectors, and how many of its cells to visit."""
    half = sample.shape[1] // 2
    k = min(MOST_WORDS, max(1, math.ceil(math.sqrt(n / PER_CELL))), len(sample))
    grid = Grid(codebook(sample[:, :half], k), codebook(sample[:, half:], k))
    rng = np.random.default_rng(11)
    some = sample[rng.choice(len(sample), min(PAIRS, len(sample)), replace=False)]
    turned = rng.standard_normal(some.shape)
    turned = unit(turned - (turned * some).sum(1)[:, None] * some + 1e-300)
    partner = cosine * some + math.sqrt(1 - cosine**2) * turned
    left, right = [some], [partner]
    found = []
    for at in range(0, len(some), 128):  # a strip of the products at a time
        close = some[at : at + 128] @ sample.T
        i, j = np.nonzero((close >= cosine) & (close < 1 - 1e-9))
        found.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(i):
        pick = rng.choice(len(i), min(len(i), PAIRS), replace=False)
        left.append(some[i[pick]])
        right.append(sample[j[pick]])
    for a, b in zip(left, right, strict=True):
        ranks = []
        for x, y in ((a, b), (b, a)):
            da, db = distances(x[:, :half], grid.first), distances(x[:, half:], grid.second)
            at = grid.cells(y)
            own = da[np.arange(len(x)), at // len(grid.second)] + db[np.arange(len(x)), at % len(grid.second)]
            ranks.append([int(np.searchsorted(np.sort((p[:, None] + q).ravel()), d + 1e-12)) for p, q, d in zip(da, db, own, strict=True)])
        grid.visits = max(grid.visits, int(np.quantile(np.minimum(*ranks), TARGET, method="higher")))
    return grid


LOCATED = "id long, copies long, vector binary, cell int, visits array<int>"


def located(nodes: DataFrame, grid: Grid) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for a in range(0, len(df), 1024):
                part = df.iloc[a : a + 1024]
                x = unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "vector": [v.tobytes() for v in x], "cell": grid.cells(x).astype(np.int32), "visits": list(grid.visited(x).astype(np.int32))})

    return nodes.mapInPandas(tidy(run), LOCATED)


def compared(rows: DataFrame, cosine: float) -> DataFrame:
    """rows (unit, one, two, member, and LOCATED) -> (a, n): n links more of node a, and (a, b): links that connect what a task connects."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        members, visitors = (df[df["member"] == x].sort_values("cell") for x in (True, False))
        if not len(members) or not len(visitors):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        m, v = (np.frombuffer(b"".join(x["vector"]), np.float64).reshape(len(x), -1) for x in (members, visitors))
        cell, ids, weight = (members[c].to_numpy(np.int64) for c in ("cell", "id", "copies"))
        home, who, heavy = (visitors[c].to_numpy(np.int64) for c in ("cell", "id", "copies"))
        goes = [frozenset(x.tolist()) for x in members["visits"]]
        by_cell: dict[int, list[int]] = {}
        for row, cells in enumerate(visitors["visits"]):
            for c in cells.tolist():
                by_cell.setdefault(c, []).append(row)
        links: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        edges = []
        for c in np.unique(cell).tolist():
            at = by_cell.get(c)
            if not at:
                continue
            a, b = np.searchsorted(cell, [c, c + 1])
            q = np.array(at)
            i, j = np.nonzero(v[q] @ m[a:b].T >= cosine)
            i, j = q[i], j + a
            keep = who[i] != ids[j]
            for p, r in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                # a pair that meets in both vectors' cells counts in one of them
                if who[p] < ids[r] or int(home[p]) not in goes[r]:
                    x, y = int(who[p]), int(ids[r])
                    links[x] = links.get(x, 0) + int(weight[r])
                    links[y] = links.get(y, 0) + int(heavy[p])
                    if (fx := find(x)) != (fy := find(y)):
                        root[fx] = fy
                        edges.append((x, y))
        # made as nullable integers: ids don't survive a detour through floating point
        no = [None] * len(edges)
        return pd.DataFrame({
            "a": pd.array([*links, *(x for x, _ in edges)], "Int64"),
            "b": pd.array([None] * len(links) + [y for _, y in edges], "Int64"),
            "n": pd.array([*links.values(), *no], "Int64"),
        })

    return rows.groupBy("unit", "one", "two").applyInPandas(run, "a long, b long, n long")


def linked(nodes: DataFrame, cosine: float) -> DataFrame:
    """nodes (id, copies, embedding) of one length -> (a, b, n) as of compared()."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()["embedding"]  # SAMPLE rows at most
    grid = fitted(unit(np.stack(sample.to_numpy()).astype(np.float64)), n, cosine)
    words = len(grid.second)
    rows = settled(located(nodes, grid), "located")
    goes = rows.withColumn("unit", F.explode(F.array_distinct(F.transform("visits", lambda c: (c / words).cast("int")))))
    lies = rows.withColumn("unit", F.floor(F.col("cell") / words).cast("int"))
    # how many chunks: a row a first-half codeword, MOST_WORDS at most
    m = {r["unit"]: -(-r["count"] // MEMBERS) for r in lies.groupBy("unit").count().collect()}
    v = {r["unit"]: -(-r["count"] // VISITORS) for r in goes.groupBy("unit").count().collect()}
    parts = [(u, m.get(u, 1), v.get(u, 1)) for u in sorted(m.keys() | v.keys())]
    parts = F.broadcast(nodes.sparkSession.createDataFrame(parts, "unit int, members int, visitors int"))
    chunk = F.xxhash64(F.lit("chunk"), "id")
    one, two = F.pmod(chunk, F.col("members")).cast("int"), F.pmod(chunk, F.col("visitors")).cast("int")
    members = lies.join(parts, "unit").select("*", F.lit(True).alias("member"), one.alias("one"), F.explode(F.expr("sequence(0, visitors - 1)")).alias("two"))
    visitors = goes.join(parts, "unit").select("*", F.lit(False).alias("member"), F.explode(F.expr("sequence(0, members - 1)")).alias("one"), two.alias("two"))
    # of a visitor's cells a unit needs its own
    visitors = visitors.withColumn("visits", F.expr(f"filter(visits, c -> cast(c / {words} as int) = unit)"))
    names = ["unit", "one", "two", "member", "id", "copies", "vector", "cell", "visits"]
    return compared(members.select(names).unionAll(visitors.select(names)), cosine)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row a vector."""
    rows = vectors.select("vec_id", "embedding")
    good = "embedding is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    valid = F.coalesce(F.expr(good), F.lit(False))
    rows = rows.select("vec_id", "embedding", F.when(valid, F.xxhash64("embedding")).alias("id"), F.when(valid, F.xxhash64(F.lit(1), "embedding")).alias("id2"))
    nodes = rows.where("id is not null").groupBy("id", "id2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    nodes = settled(nodes, "nodes")
    lengths = [r[0] for r in nodes.select(F.size("embedding")).distinct().collect()]
    found = None
    for length in sorted(lengths):
        part = linked(nodes.where(F.size("embedding") == length).select("id", "copies", "embedding"), cosine)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    found = settled(found, "links")
    label = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    named = nodes.drop("embedding").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").join(links, "id", "left").select("id", "id2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "id", "id2").join(named, ["id", "id2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
