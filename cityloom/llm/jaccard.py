"""Op 7: n-gram Jaccard join by count-vector R-trees.

A document is the set of its distinct word shingles, hashed to 64 bits. Hashing shingles into groups gives a point of group
counts; the overlap of two sets is at most the sum of their points' coordinate minima. Trees over such points, whose nodes
hold coordinate maxima, find the pairs whose bound reaches what the similarity needs; those are verified on the sets. A set
has a group for two to four shingles, a power of two of them, so that the bound stays close at every size; a point folds to half its
groups to meet one of the next smaller size. Pairs that are looked for again meet by finer points, of a group for half a shingle to one,
as near copies that are just not similar enough all pass the coarse bound.

One tree over all documents would compare each with much of it, as maxima over many points bound little. So trees are built
in blocks: two sets that are similar enough share a shingle among the first n - ceil(t n) + 1 of each, in any order that
holds for all sets. The order puts shingles from rarely hit hash buckets first (counted over all documents), so what very
many documents share makes no block. Equal sets are one node from the start, and blocks of the same members are one block.
Blocks say which sets may meet at all; every pair that is verified comes out of a tree.

Only connectedness is asked for, so links that add nothing are not made. First the trees of each block give every member's best
partner by the bound; large blocks are cut into chunks, with the block's most connected member in each, whose pairs that the bound
lets through are made too. These pairs are verified. Blocks whose trees let through more than that, and those in
chunks, are looked at again if their members are not all connected by now: every pair of chunks is joined by trees, and every pair
of sets that is not yet connected and that the bound lets through is verified. No link between different components is lost.

Cases: null, empty and blank texts have the empty set, which links with nothing; fewer words than a shingle's are one
shingle; rows that repeat a doc_id are each judged by their text; an empty table gives an empty result; further columns
are ignored, whatever their names. Sets are told apart by 128 bits of hash, the nodes of the graph by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.llm.common import batches_of, for_pandas, ids_of, released, settled, table, tidy
from cityloom.llm.components import components

LEAST_GROUPS = 32
CLASSES = 4
ORDER_BITS = 16
CHUNK = 128
#: First pass's chunks to one of the second, which sends each member to all chunks of its block.
AGAIN_CHUNKS = 2
LEAF = 32
#: Groups of a fine point to those of a coarse one, and how many it has at most, beyond what the coarse one has.
FINER, FINEST = 4, 8192
KEPT = 200_000
#: Bytes of points that pair_bounds() looks up at once on a side, rows that go to Python at once.
STRIP, BATCH = 1 << 22, 2_000
#: Sets to be looked up that are sent to every task, at some 40 bytes each.
BROADCAST_ROWS = 400_000
FULL, WITHOUT_BOUND = 15, 120
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(64 - ORDER_BITS)
REST = np.uint64((1 << (64 - ORDER_BITS)) - 1)


class Words(dict):
    """Word -> 64-bit hash, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int, words: Words, order: np.ndarray | None = None) -> np.ndarray:
    """The distinct shingles' hashes, ascending; order: of hash buckets, by which the hashes are renamed. bytes.lower and bytes.split know A-Z and the six ASCII spaces only, as is asked for."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out *= MIX
        out += h[i : len(h) - k + 1 + i]
    out = mixed(out)
    if order is not None:  # a renaming of the buckets: still one number a shingle
        out = (order[out >> LOW] << LOW) | (out & REST)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def needed(a, b, percent: int):
    """The least overlap of sets of a and b elements for 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def first_ones(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- documents --------------------------------------------------------------------------------------------------------


def bucket_order(docs: DataFrame, width: int) -> np.ndarray:
    """The place of each of 2 ** ORDER_BITS hash buckets by how many shingles of all documents fall into it, fewest first."""
    n = 1 << ORDER_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Words(), np.zeros(n, np.int64)
        for df in batches:
            texts = df["text"].tolist()
            for a in range(0, len(texts), 256):
                hashes = np.concatenate([shingles(t, width, words) for t in texts[a : a + 256]])
                total += np.bincount((hashes >> LOW).astype(np.int64), minlength=n)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    sums = docs.select("text").mapInPandas(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(n, np.int64)
    for r in sums.collect():  # a row a bucket at most
        counts[r["bucket"]] = r["n"]
    out = np.empty(n, np.uint64)
    out[np.argsort(counts, kind="stable")] = np.arange(n, dtype=np.uint64)
    return out


SETS = "doc_id long, print long, n long, s1 long, s2 long, point binary, fine binary, first array<long>"


def described(docs: DataFrame, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """Each document's hash of the text, number of shingles, the set's hash, its points and its first shingles in the common order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for df in batches:
            rows = []
            for doc_id, told, text in zip(ids_of(df), df["print"].tolist(), df["text"], strict=True):
                s = shingles(text, width, words, order)
                n = len(s)
                key = xxhash.xxh128_digest(s.tobytes())
                s1, s2 = np.frombuffer(key, np.int64).tolist()
                rows.append((doc_id, told, n, s1, s2, *points_of(s), s[: first_ones(n, percent)].view(np.int64) if n else s.view(np.int64)))
            out = pd.DataFrame([r[1:] for r in rows], columns=["print", "n", "s1", "s2", "point", "fine", "first"])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], "Int64"))
            yield out

    return for_pandas(docs.withColumn("print", F.xxhash64("text")), "print", "text").mapInPandas(tidy(run), SETS)


# --- trees ------------------------------------------------------------------------------------------------------------


class Tree:
    """Points packed into leaves, by size and then by their most varied coordinates; nodes hold coordinate maxima and sizes' range."""

    def __init__(self, points: np.ndarray, n: np.ndarray) -> None:
        self.order = self.packed(points, n, np.arange(len(n)), 0)
        self.points, self.n = points[self.order], n[self.order]
        starts = np.arange(0, len(n), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts))]
        while len(self.levels[-1][1]) > LEAF:
            most, least, largest = self.levels[-1]
            starts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(most, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(largest, starts)))

    def packed(self, points: np.ndarray, n: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        key = n[rows] if depth == 0 else points[rows, int(np.argmax(points[rows].var(axis=0)))]
        rows = rows[np.argsort(key, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self.packed(points, n, rows[:half], depth + 1), self.packed(points, n, rows[half:], depth + 1)])

    def join(self, points: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound): which of the given points meets which point of the tree, as far as bounds and sizes allow the similarity."""
        top = len(self.levels[-1][1])
        i, node = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, least, largest = self.levels[depth]
            allowed = (100 * n[i] >= percent * least[node]) & (100 * largest[node] >= percent * n[i])
            i, node = i[allowed], node[allowed]
            ok = pair_bounds(most, node, points, i) >= needed(n[i], np.maximum(least[node], -(-percent * n[i] // 100)), percent)
            i, node = i[ok], node[ok]
            size = len(self.levels[depth - 1][1]) if depth else len(self.n)
            i, node = np.repeat(i, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            i, node = i[node < size], node[node < size]
        allowed = 100 * np.minimum(n[i], self.n[node]) >= percent * np.maximum(n[i], self.n[node])
        i, node = i[allowed], node[allowed]
        bound = pair_bounds(self.points, node, points, i)
        ok = bound >= needed(n[i], self.n[node], percent)
        return i[ok], self.order[node[ok]], bound[ok]


def pair_bounds(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """bounds() of x[i] and y[j], pair by pair, some at a time."""
    out, step = np.empty(len(i), np.int32), max(1, STRIP // x.shape[1])
    for a in range(0, len(i), step):
        out[a : a + step] = np.minimum(x[i[a : a + step]], y[j[a : a + step]]).sum(axis=1, dtype=np.int32)
    return out


def points_of(s: np.ndarray) -> tuple[bytes, bytes]:
    """Group counts of the coarse and the fine point."""
    coarse = max(LEAST_GROUPS, 1 << max(0, (len(s) - 1).bit_length() - 2)) if len(s) else LEAST_GROUPS
    fine = max(coarse, min(FINER * coarse, FINEST))
    counts = np.bincount((s & np.uint64(fine - 1)).astype(np.int64), minlength=fine)
    return nibbles(counts.reshape(-1, coarse).sum(axis=0)), nibbles(counts)


def nibbles(counts: np.ndarray) -> bytes:
    """Counts, four bits each; FULL stands for that and more."""
    counts = np.minimum(counts, FULL).astype(np.uint8)
    return (counts[0::2] | (counts[1::2] << 4)).tobytes()


def as_points(column, fold: bool = False) -> np.ndarray:
    """Counts of points of one size, a row each; fold: to half the groups. A count that was too large to hold bounds nothing."""
    column = list(column)
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    out = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(column), -1)
    out[out == FULL] = WITHOUT_BOUND
    if fold:
        half = out.shape[1] // 2
        out = np.minimum(out[:, :half].astype(np.uint16) + out[:, half:], WITHOUT_BOUND).astype(np.uint8)
    return out


def bounds(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.minimum(points, point).sum(axis=1, dtype=np.int32)


def tree_pairs(points: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound) with i among left, j among right and i <> j that a tree lets through; points of neighbouring sizes meet folded. Where left
    is right each pair comes once."""
    size = np.array([len(x) for x in points])
    found = []

    def meet(left: np.ndarray, right: np.ndarray, fold: bool, once: bool) -> None:
        if len(left) and len(right):
            i, j, bound = Tree(as_points(points[right], fold), n[right]).join(as_points(points[left]), n[left], percent)
            i, j = left[i], right[j]
            ok = i < j if once else i != j
            found.append((i[ok], j[ok], bound[ok]))

    same = left is right
    for s in np.unique(size[left]).tolist():
        own = left[size[left] == s]
        meet(own, own if same else right[size[right] == s], False, same)
        meet(own, right[size[right] == 2 * s], True, False)
    if not same:
        for s in np.unique(size[right]).tolist():
            meet(right[size[right] == s], left[size[left] == 2 * s], True, False)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def by_runs(rows: DataFrame, keys: list[str], judge, schema: str) -> DataFrame:
    """judge(columns of a run as arrays) -> rows, for each run of equal keys; rows must be sorted by them within partitions."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(df: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
            columns = {c: df[c].to_numpy() for c in df.columns}
            out = [judge({c: x[a:b] for c, x in columns.items()}) for a, b in spans]
            return pd.DataFrame({c: pd.array(np.concatenate([x[k] for x in out]) if out else [], "Int64") for k, c in enumerate(names)})

        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            cut = np.zeros(len(df) - 1, bool)
            for c in keys:
                v = df[c].to_numpy()
                cut |= v[1:] != v[:-1]
            edge = [0, *(np.flatnonzero(cut) + 1).tolist(), len(df)]
            yield judged(df, list(zip(edge[:-2], edge[1:-1], strict=True)))
            rest = df.iloc[edge[-2] :].reset_index(drop=True)  # its run may go on in the next batch
        if rest is not None and len(rest):
            yield judged(rest, [(0, len(rest))])

    return rows.mapInPandas(tidy(run), schema)


def spanning_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (block, chunk, chunks, id, n, lead, point) sorted by block and chunk -> pairs (a, b) to verify first, again 0; and blocks (a) to be
    looked at again, again 1."""

    def judge(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, first = np.unique(x["id"], return_index=True)  # the lead stands in its own chunk twice
        n, points, lead = x["n"][first], x["point"][first], np.isin(ids, x["id"][x["lead"].astype(bool)])
        every = np.arange(len(ids))
        i, j, bound = tree_pairs(points, n, every, every, percent)
        u, v, share = np.r_[i, j], np.r_[j, i], np.r_[bound, bound] / (n[np.r_[i, j]] + n[np.r_[j, i]])
        order = np.lexsort((v, -share, u))
        u, v = u[order], v[order]
        keep = np.r_[True, u[1:] != u[:-1]][: len(u)] | lead[u]
        pairs = np.unique(np.stack([np.minimum(u, v)[keep], np.maximum(u, v)[keep]]), axis=1)
        again = x["block"][: int(x["chunks"][0] > 1 or pairs.shape[1] < len(i))]
        no, none = np.zeros(pairs.shape[1], np.int64), np.zeros(len(again), np.int64)
        return np.r_[ids[pairs[0]], again], np.r_[ids[pairs[1]], none], np.r_[no, none + 1]

    return by_runs(rows, ["block", "chunk"], judge, "a long, b long, again long")


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (block, one, two, side, id, component, n, point) sorted by block and chunk pair -> pairs (a, b) the trees let through; point: the fine one."""

    def judge(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, comp, side, one, two = x["id"], x["component"], x["side"], x["one"][0], x["two"][0]
        if (comp == comp[0]).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.flatnonzero(side == one)
        right = left if one == two else np.flatnonzero(side == two)
        i, j, _ = tree_pairs(x["point"], x["n"], left, right, percent)
        ok = comp[i] != comp[j]
        i, j = ids[i[ok]], ids[j[ok]]
        return np.minimum(i, j), np.maximum(i, j)

    return by_runs(rows, ["block", "one", "two"], judge, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked; sets has id and shingles, ascending, as bytes."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ok = []
            for x, y in zip(df["x"], df["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield df.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.join(first, "a").join(second, "b").mapInPandas(tidy(run), "a long, b long")


# --- join -------------------------------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id connected), a row a document."""
    return labelled_texts(docs, width, percent).drop("print")


def labelled_texts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As jaccard_components, with print, the text's hash: of several texts of a doc_id each has its own component."""
    with batches_of(docs.sparkSession, BATCH):
        return labels_of(docs.select("doc_id", "text"), width, percent)


def labels_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    order = bucket_order(docs, width)
    found = settled(described(docs, width, percent, order), "sets")
    key = ["n", "s1", "s2"]
    nodes = found.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("low"), F.min_by(F.struct("point", "fine"), "doc_id").alias("p"))
    nodes = settled(nodes.select("n", F.col("s1").alias("id"), "s2", "low", "p.point", "p.fine"), "nodes")
    # one row a set: that of its least document
    one = found.select("doc_id", *key, "first").join(nodes.select("n", F.col("id").alias("s1"), "s2", F.col("low").alias("doc_id")), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    tokens = one.select(F.col("s1").alias("id"), "n", F.explode("first").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("id") % (1 << 40)).alias("print")).where("size > 1")
    shared = settled(tokens.join(counts.hint("merge"), "token"), "shared")
    # blocks with the same members are one
    alike = shared.groupBy("size", "print").agg(F.min("token").alias("token")).select("token")
    blocks = settled(shared.join(alike.hint("merge"), "token", "left_semi").select(F.col("token").alias("block"), "id", "n"), "blocks")
    released(shared)
    # sizes that may be similar lie at most CLASSES classes apart; who has no such other in a block has no partner there
    blocks_of = blocks.withColumn("_c", F.floor(CLASSES * F.log("n") / (1.0001 * max(math.log(100 / percent), 0.01))).cast("int"))
    classes = blocks_of.groupBy("block", "_c").agg(F.count("*").alias("_m")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_m"))).alias("_m"))
    others = F.expr(f"aggregate(sequence(_c - {CLASSES}, _c + {CLASSES}), 0L, (a, c) -> a + coalesce(try_element_at(_m, c), 0L))")
    kept = blocks_of.join(classes.hint("merge"), "block").where(others > 1)
    size = F.expr("aggregate(map_values(_m), 0L, (a, x) -> a + x)")
    blocks = settled(kept.select("block", "id", "n", F.ceil(size / CHUNK).cast("int").alias("chunks")), "sized")
    # a large block's lead is the member that is in most blocks, as a text is that the others are copies of
    common = blocks.groupBy("id").agg(F.count("*").alias("common"))
    leads = blocks.where("chunks > 1").join(common.hint("merge"), "id").groupBy("block").agg(F.max(F.struct("common", "id", "n", "chunks")).alias("lead"))
    leads = leads.select("block", F.col("lead.id").alias("id"), F.col("lead.n").alias("n"), F.col("lead.chunks").alias("chunks"))
    points = nodes.select("id", "n", "point")
    several = bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets that some pairs need, from their texts: only of what the points let through."""
        ids = settled(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        low = ids.join(nodes.select("id", F.col("low").alias("doc_id")), "id")
        if ids.count() <= BROADCAST_ROWS:  # beyond that size both sides are dealt by doc_id
            low = F.broadcast(low)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words()
            for df in batches:
                yield pd.DataFrame({"id": df["id"], "shingles": [shingles(t, width, words, order).tobytes() for t in df["text"]]})

        sets = docs.join(low, "doc_id").mapInPandas(tidy(run), "id long, shingles binary")
        # ids that stand on several rows: only the row whose set it is
        return settled(sets.mapInPandas(tidy(checked), "id long, shingles binary").dropDuplicates(["id"]) if several else sets, "shingles")

    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int")
    everywhere = leads.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("lead", F.lit(True))
    members = blocks.withColumn("chunk", chunk).withColumn("lead", F.lit(False)).unionAll(everywhere).join(points.drop("n").hint("merge"), "id")
    spread = members.repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    seen = settled(spanning_pairs(spread, percent), "seen")
    first = settled(seen.where("again = 0").select("a", "b").distinct(), "pairs")
    links = settled(verified(first, sets_of(first), percent), "links")
    label = settled(components(links), "components")
    again = seen.where("again = 1").select(F.col("a").alias("block")).distinct()
    labelled = blocks.join(again.hint("merge"), "block", "left_semi").join(label.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = settled(labelled, "labelled")
    parted = labelled.groupBy("block").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("block")
    rest = settled(labelled.join(parted, "block"), "rest")
    # the fine points of those alone are dealt out
    asked = settled(rest.select("id").distinct(), "ids")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    fine = nodes.join(asked, "id", "left_semi").select("id", F.col("fine").alias("point"))
    rest = rest.join(fine, "id").withColumn("chunks", F.ceil(F.col("chunks") / AGAIN_CHUNKS)).withColumn("side", chunk).withColumn("_other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rest = rest.select("block", F.least("side", "_other").alias("one"), F.greatest("side", "_other").alias("two"), "side", "id", "component", "n", "point")
    rest = rest.repartition("block", "one", "two").sortWithinPartitions("block", "one", "two")
    more = settled(block_pairs(rest, percent).distinct(), "pairs")
    more = settled(verified(more, sets_of(more), percent), "links")
    label = settled(components(links.unionAll(more)), "components")
    of_set = nodes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = of_set.groupBy("component").agg(F.min("low").alias("component_id"))
    named = of_set.join(lows, "component").select("n", F.col("id").alias("s1"), "s2", "component_id")
    out = found.select("doc_id", "print", *key).join(named, key, "left")
    return out.select("doc_id", "print", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops rows whose shingles aren't those that the id is the hash of."""
    for df in batches:
        ok = [np.frombuffer(xxhash.xxh128_digest(x), np.int64)[0] == i for i, x in zip(df["id"], df["shingles"], strict=True)]
        yield df[np.array(ok, bool)]


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies: that with the least doc_id, once. Rows without doc_id all stay."""
    several = bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
    found = labelled_texts(docs, width, percent)
    if not several:
        left = docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")
    else:
        # texts are told apart by their hashes: others of the doc_id may be no copies; of several in a group that with the least hash stays
        found = settled(found.where("n_shingles > 0 and doc_id is not null"), "found")
        stays = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("print").alias("_stays"))
        gone = found.join(stays, "component_id").where("doc_id <> component_id or print <> _stays").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct()
        left = docs.join(gone, (F.col("_id") == docs["doc_id"]) & (F.col("_print") == F.xxhash64(docs["text"])), "left_anti")
        nth = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.length("text")))
        left = left.withColumn("_nth", nth).where("_nth = 1 or doc_id is null").drop("_nth")
    return left.select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
