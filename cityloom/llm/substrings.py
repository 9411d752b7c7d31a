"""Op 8: removal of repeated word windows, found by recompression.

Recompression names text bottom-up by rules that look at nothing but the symbols themselves: a round names every run of
equal symbols, then splits the symbols into left and right ones by a keyed hash and names every left-right pair. Names are
hashes of what they stand for, so they are global without any exchange, and equal substrings get equal symbols inside; only
what depends on words beyond their ends differs. Every symbol here carries that dependence: the words that fix it.

A window of WINDOW words contains some symbols with all they depend on (of the last round, else of an earlier one, else its
words). The least by hash is its anchor: equal windows have equal anchors at equal places. Anchors are few, a seventh of the
words, and are all that is shuffled for every text. Anchors that recur reveal repeats, and those are verified: occurrences
that agree in all words of all their windows are one class, whose first occurrence stays; where an anchor has several
classes, the single windows of their first occurrences are hashed and compared. The verdict is on the input's windows.

Hot passages: occurrences are reduced to classes in every batch before the shuffle, so a text that a third of all rows
share arrives as one row a batch; later joins are equi-joins that adaptive execution splits.

Cases: null, empty and blank texts have no words and keep none; documents shorter than a window keep all words; rows that
repeat both doc_id and text are one document and get equal results, other texts of a doc_id follow it in the order of their
hashes; rows without doc_id take no part and keep all words; an empty table gives an empty result; further columns are
ignored, whatever their names. Words are compared by 64-bit hashes, windows and spans by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.llm.common import for_pandas, ids_of, settled, table, tidy
from cityloom.llm.jaccard import MIX, Words, mixed

WINDOW = 20
ROUNDS = 2
AT_ONCE = 150_000
FAR = 1 << 60
BASE = 0x9E3779B97F4A7C15 | 1
SECOND = 0xC2B2AE3D27D4EB4F | 1


# --- recompression ----------------------------------------------------------------------------------------------------


class Symbols:
    """A level: names, and the words [low, high) that fix each."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high = name, low, high


def named_runs(x: Symbols) -> Symbols:
    """Runs of equal symbols become one; that a run ends is known from the symbol beyond."""
    first = np.flatnonzero(np.r_[True, x.name[1:] != x.name[:-1]])
    last = np.r_[first[1:], len(x.name)] - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, mixed(x.name[first] * MIX + length), x.name[first])
    low = np.r_[-1, x.low[first[1:] - 1]]
    high = np.r_[x.high[first[1:]], FAR]
    return Symbols(name, low, high)


def named_pairs(x: Symbols, turn: int) -> Symbols:
    """A left symbol and the right one after it become one. A left one that stays is known from the next, a right one from the one before."""
    seed = np.uint64((turn + 1) * int(MIX) % (1 << 64))
    right = (mixed(x.name + seed) >> np.uint64(63)).astype(bool)
    joins = np.r_[~right[:-1] & right[1:], False]
    joined = np.r_[False, joins[:-1]]
    keep = np.flatnonzero(~joined)
    after = np.r_[x.name[1:], np.uint64(0)]
    name = np.where(joins, mixed(x.name * MIX + mixed(after + np.uint64(1))), x.name)[keep]
    high = np.where(right, x.high, np.r_[x.high[1:], FAR])[keep]  # a left one: of the next, joined or not
    low = np.where(right, np.r_[-1, x.low[:-1]], x.low)[keep]
    return Symbols(name, low, high)


def levels(words: np.ndarray, rounds: int) -> list[Symbols]:
    at = np.arange(len(words))
    out = [Symbols(words, at, at + 1)]
    for turn in range(rounds):
        out.append(named_pairs(named_runs(out[-1]), turn))
    return out


def anchors(words: np.ndarray, inner: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, name, level) of the anchor of each window that starts at one of `inner`, ascending."""
    n = len(inner)
    low, high, name, level = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    todo = np.arange(n)
    for depth, x in reversed(list(enumerate(levels(words, rounds)))):
        if not len(todo):
            break
        # symbols stand in order, and so do the ends of what fixes them: those inside a window are neighbours
        a = np.searchsorted(x.low, inner[todo], "left")
        b = np.searchsorted(x.high, inner[todo] + window, "right") - 1
        some = b >= a
        rows, a, b = todo[some], a[some], b[some]
        if len(rows):
            rank = (mixed(x.name ^ np.uint64(0x5851F42D4C957F2D)) & ~np.uint64(0xFFFFFF)) | np.arange(len(x.name), dtype=np.uint64) % np.uint64(1 << 24)
            best = least_between(rank, a, b)
            low[rows], high[rows], name[rows], level[rows] = x.low[best], x.high[best], x.name[best], depth
        todo = todo[~some]
    return low, high, name, level


def least_between(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where rank is least in each a..b, both included."""
    tables = [rank]
    span = b - a + 1
    k = np.floor(np.log2(span)).astype(np.int64)
    for i in range(int(k.max()) if len(k) else 0):
        t = tables[-1]
        tables.append(np.minimum(t, np.r_[t[1 << i :], np.full(min(1 << i, len(t)), t.max() if len(t) else 0)]) if len(t) > 1 << i else t)
    out = np.zeros(len(a), np.uint64)
    for i, t in enumerate(tables):
        at = k == i
        out[at] = np.minimum(t[a[at]], t[b[at] - (1 << i) + 1])
    # the rank's last bits are the place, up to a multiple of 2 ** 24
    place = (out & np.uint64(0xFFFFFF)).astype(np.int64)
    return a + (place - a) % (1 << 24)


class Spans:
    """Hashes of word ranges, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        inverse = pow(base, -1, 1 << 64)
        n = len(words)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed(words ^ np.uint64(base)) * np.cumprod(up)[:n])]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * MIX)


# --- first pass -------------------------------------------------------------------------------------------------------

#: kind 0: an anchor's occurrence, to be compared by key; kind 1: words [at, until) of the document are repeats.
FOUND = "kind int, key long, span long, doc_id long, nth int, at int, lo int, hi int, until int"


def occurrences(doc_id: np.ndarray, nth: np.ndarray, texts: list[list[bytes]], words: Words, window: int, rounds: int) -> dict[str, np.ndarray]:
    """The anchors of some documents' windows, a row for each run of windows that share one."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size  # a sign that stands nowhere else goes before each document and at the end
    h = np.empty(int((size + 1).sum()) + 1, np.uint64)
    h[first - 1] = mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(1 << 40))
    h[-1] = mixed(np.uint64([len(texts) + (1 << 40)]))[0]
    for a, t in zip(first.tolist(), texts, strict=True):
        h[a : a + len(t)] = np.fromiter(map(words.__getitem__, t), np.uint64, len(t))
    wide = np.flatnonzero(size >= window)
    count = size[wide] - window + 1
    owner = np.repeat(wide, count)
    inner = first[owner] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    low, high, name, level = anchors(h, inner, window, rounds)
    run = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (level[1:] != level[:-1]) | (owner[1:] != owner[:-1])]) if len(inner) else np.zeros(0, np.int64)
    last = np.r_[run[1:], len(inner)] - 1 if len(run) else run
    at, lo, hi = low[run], inner[run], inner[last]
    key = mixed(Spans(h, BASE).of(at, high[run]) + name[run] * MIX + level[run].astype(np.uint64))
    span = Spans(h, SECOND).of(lo, hi + window)
    own = owner[run]
    return {"key": key.view(np.int64), "span": span.view(np.int64), "doc_id": doc_id[own], "nth": nth[own], "at": at - first[own], "lo": lo - at, "hi": hi - at}


def classes_of(found: dict[str, np.ndarray], window: int) -> pd.DataFrame:
    """Occurrences of one batch -> the first of each class, and the words of the others, as repeats."""
    df = pd.DataFrame(found).sort_values(["key", "span", "lo", "hi", "doc_id", "nth", "at"], kind="stable")
    same = ["key", "span", "lo", "hi"]
    v = df[same].to_numpy()
    new = np.r_[True, (v[1:] != v[:-1]).any(axis=1)] if len(df) else np.zeros(0, bool)
    lead = df[new].assign(kind=0, until=0)
    who = df[["doc_id", "nth", "at"]].to_numpy()
    first = who[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(df) else who
    other = df[~new & (who != first).any(axis=1)]
    repeats = merged(other.assign(start=other["at"] + other["lo"], until=other["at"] + other["hi"] + window))
    return pd.concat([lead, repeats], ignore_index=True)


def merged(df: pd.DataFrame) -> pd.DataFrame:
    """Ranges [start, until) of documents, those that touch joined, as rows of kind 1."""
    df = df.sort_values(["doc_id", "nth", "start"])
    doc, nth, start, until = (df[c].to_numpy(np.int64) for c in ("doc_id", "nth", "start", "until"))
    if not len(df):
        cut = np.zeros(0, np.int64)
    else:
        new = np.r_[True, (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (start[1:] > until[:-1])]  # ends rise with starts
        cut = np.flatnonzero(new)
    end = np.maximum.reduceat(until, cut) if len(cut) else until
    zero = np.zeros(len(cut), np.int64)
    rows = {"kind": zero + 1, "key": mixed(doc[cut].astype(np.uint64) + start[cut].astype(np.uint64)).view(np.int64), "span": zero, "doc_id": doc[cut], "nth": nth[cut], "at": start[cut], "lo": zero, "hi": zero, "until": end}
    return pd.DataFrame(rows)


def anchored(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """docs (doc_id, nth, text) -> FOUND."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for df in batches:
            doc_id, nth = df["doc_id"].to_numpy(np.int64), df["nth"].to_numpy(np.int64)
            parts, texts, first, held = [], [], 0, 0
            for i, text in enumerate(df["text"]):
                texts.append((text or "").encode("utf-8", "surrogatepass").split())
                held += len(texts[-1])
                if held >= AT_ONCE or i + 1 == len(df):
                    parts.append(occurrences(doc_id[first : i + 1], nth[first : i + 1], texts, words, window, rounds))
                    texts, first, held = [], i + 1, 0
            if parts:
                yield classes_of({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, window)[names]

    return docs.mapInPandas(tidy(run), FOUND)


#: kind 1: words [at, until) are repeats; kind 2: windows that start in [at, until) are to be compared one by one.
JUDGED = "kind int, doc_id long, nth int, at int, until int"


def judged(found: DataFrame, window: int) -> DataFrame:
    """FOUND, a key's rows together and in order -> JUDGED."""

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        passed = df[df["kind"] == 1][["kind", "doc_id", "nth", "at", "until"]]
        df = df[df["kind"] == 0]
        if not len(df):
            return passed
        key = df["key"].to_numpy()
        v = df[["key", "span", "lo", "hi"]].to_numpy()
        who = df[["doc_id", "nth", "at"]].to_numpy(np.int64)
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_class = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
        first = who[np.flatnonzero(new_class)[np.cumsum(new_class) - 1]]
        at, lo, hi = (df[c].to_numpy(np.int64) for c in ("at", "lo", "hi"))
        other = ~new_class & (who != first).any(axis=1)
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=new_class)[group] > 1
        ask = new_class & several
        return pd.concat([
            passed,
            pd.DataFrame({"kind": 1, "doc_id": who[other, 0], "nth": who[other, 1], "at": (at + lo)[other], "until": (at + hi + window)[other]}),
            pd.DataFrame({"kind": 2, "doc_id": who[ask, 0], "nth": who[ask, 1], "at": (at + lo)[ask], "until": (at + hi + 1)[ask]}),
        ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            cut = int(np.searchsorted(df["key"].to_numpy(), df["key"].iloc[-1], "left"))
            rest = df.iloc[cut:]  # the last key may go on in the next batch
            yield judge(df.iloc[:cut])
        if rest is not None:
            yield judge(rest)

    return found.mapInPandas(tidy(run), JUDGED)


# --- verdict ----------------------------------------------------------------------------------------------------------


def summary(words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(words, removed, hash of the kept) with the words in the ranges removed."""
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[b] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


DRAFT = "doc_id long, nth int, n_words long, n_removed long, kept_sha256 string, text string, ranges array<struct<at: int, until: int>>, windows array<struct<h1: long, h2: long, at: int>>"


def drafted(docs: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, nth, text, judged) -> results where no single windows are asked about, else text, ranges and windows."""
    names = ["doc_id", "nth", "n_words", "n_removed", "kept_sha256", "text", "ranges", "windows"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for df in batches:
            rows = []
            for doc_id, nth, text, told in zip(ids_of(df), df["nth"], df["text"], df["judged"], strict=True):
                tokens = (text or "").encode("utf-8", "surrogatepass").split()
                told = [] if told is None else [x if isinstance(x, dict) else x.asDict() for x in told]
                ranges = [(x["at"], x["until"]) for x in told if x["kind"] == 1]
                ask = [(x["at"], x["until"]) for x in told if x["kind"] == 2]
                if not ask:
                    rows.append((doc_id, nth, *summary(tokens, ranges), None, None, None))
                    continue
                h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
                at = np.unique(np.concatenate([np.arange(a, b) for a, b in ask]))
                h1, h2 = (Spans(h, base).of(at, at + window).view(np.int64).tolist() for base in (BASE, SECOND))
                windows = [{"h1": a, "h2": b, "at": c} for a, b, c in zip(h1, h2, at.tolist(), strict=True)]
                rows.append((doc_id, nth, len(tokens), None, None, text, [{"at": a, "until": b} for a, b in ranges], windows))
            out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], "Int64"))
            yield out.astype({"n_words": "Int64", "n_removed": "Int64"})

    return for_pandas(docs, "nth", "text", "judged").mapInPandas(tidy(run), DRAFT)


def repeats_removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, a row a document."""
    docs = docs.select("doc_id", "text")
    if docs.select("doc_id").groupBy("doc_id").count().where("count > 1").take(1):
        # several rows of an id: their texts in the order of their hashes
        docs = docs.withColumn("nth", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"))) - 1)
    else:
        docs = docs.withColumn("nth", F.lit(0))
    found = anchored(docs.where("doc_id is not null").select("doc_id", "nth", "text"), window, rounds)
    # a key's rows in one place; there are few of a key, as every batch sends one of each class
    ordered = found.repartition("key").sortWithinPartitions("key", "span", "lo", "hi", "doc_id", "nth", "at")
    told = settled(judged(ordered, window), "judged")
    per_doc = told.groupBy("doc_id", "nth").agg(F.collect_list(F.struct("kind", "at", "until")).alias("judged"))
    draft = settled(drafted(docs.join(per_doc, ["doc_id", "nth"], "left").select("doc_id", "nth", "text", "judged"), window), "draft")
    done = draft.where("windows is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    asked = draft.where("windows is not null")
    each = asked.select("doc_id", "nth", F.explode("windows").alias("w")).select("doc_id", "nth", "w.*")
    start = F.struct("doc_id", "nth", "at")
    firsts = each.groupBy("h1", "h2").agg(F.min(start).alias("first"), F.max(start).alias("last")).where("first < last").drop("last")
    again = each.join(firsts, ["h1", "h2"]).where(start > F.col("first")).groupBy("doc_id", "nth").agg(F.collect_list("at").alias("again"))
    last = asked.select("doc_id", "nth", "text", "ranges").join(again, ["doc_id", "nth"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for doc_id, text, ranges, again in zip(df["doc_id"], df["text"], df["ranges"], df["again"], strict=True):
                cover = [(x["at"], x["until"]) for x in (y if isinstance(y, dict) else y.asDict() for y in ranges)]
                cover += [(a, a + window) for a in (again if again is not None else [])]
                rows.append((doc_id, *summary((text or "").encode("utf-8", "surrogatepass").split(), cover)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return done.unionAll(last.mapInPandas(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
