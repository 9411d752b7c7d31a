"""Op 5: toxicity by a learned lexicon, matched through Levenshtein automata, weighed by its context.

Learning: from a sample of labelled rows, bounded by TRAIN_ROWS, words and word beginnings are counted by class. Those whose
likelihood ratio beats chance over all candidates, and that hardly occur in clean rows, are the lexicon. Near copies in the
sample (by sketches of its rows) count as one row, else every word of a text with many copies would look like evidence.

Matching: the lexicon is a trie; every term accepts a number of edits that grows with its length (none for short ones). Trie
and edit automaton are intersected by running their product on a word, letter by letter; product states are kept as a
deterministic automaton that is built as words need it, so most words die after a few table lookups.

Context: a match counts less inside quotation marks, and least where a word of reporting stands near it; it counts more next
to a word of address. What counts is by how much the weighed matches exceed the number that clean texts of that length have;
a logistic model over that, fitted on the same bounded sample, gives the score.

Cases: null and empty texts have no matches and get the model's score for that; repeated rows get equal scores; without
labels of both classes every score is the share of label 1 (0 without labels); an empty table gives an empty result;
further columns are ignored, whatever their names; rows of labels without doc_id or label are left out, and of several
labels of a document the highest counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import table, tidy

TRAIN_ROWS = 12_000
TERMS = 2000
SKETCHES = 6
BEGINNINGS = (3, 4, 5, 6, 7, 8)
LEAST_ROWS, LEAST_PRECISION = 3, 0.7
FEATURES = 4
COVERED, CLEARER, LIFT = 0.8, 1.5, 4.0
THRESHOLD = 0.3
WORD_CACHE = 200_000

TOKEN = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
LEET = str.maketrans("013457@$", "oieastas")
WINDOW = 6
#: Opening quotation signs and what closes them; straight signs take turns within a paragraph.
QUOTES = {"“": "”", "„": "“”", "«": "»", '"': '"'}
SIGNS = re.compile(r"[“”„«»\"]|\n\s*\n")
STEPS = 500_000
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes called calls according reported reports term word insult slur sagte sagt schrieb zitat nannte nennt "
    "laut dit disait écrit cite citation appelle selon dijo dice escribió cita llamó llama según".split()
)
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


# --- lexicon ----------------------------------------------------------------------------------------------------------


def terms_of(text: str) -> set[str]:
    """Words, and beginnings (with a star) of longer words."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of the labelled rows learned from: at most `most`, those whose ids hash lowest."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def without_copies(rows: DataFrame) -> DataFrame:
    """One row of each group of near copies: rows that agree in both minima of a band, of SKETCHES bands over word triples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for text in df["text"]:
                words = TOKEN.findall((text or "").lower())
                grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
                hashes = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)
                lows = [int((hashes * np.uint64(2 * k + 0x9E3779B1) % np.uint64(4294967291)).min()) for k in range(1, 2 * SKETCHES + 1)]
                out.append([f"{k}:{lows[2 * k]}:{lows[2 * k + 1]}" for k in range(SKETCHES)])
            yield pd.DataFrame({"doc_id": df["doc_id"].values, "bands": out})

    found = rows.mapInPandas(tidy(run), "doc_id long, bands array<string>").collect()  # TRAIN_ROWS rows at most
    group: dict = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    for r in found:
        for band in r["bands"]:
            group[root(band)] = root(r["doc_id"])
    first: dict = {}
    for r in found:
        first[k] = min(r["doc_id"], first.get(k := root(r["doc_id"]), r["doc_id"]))
    ids = rows.sparkSession.createDataFrame([(x,) for x in first.values()], "doc_id long")
    return rows.join(F.broadcast(ids), "doc_id")


def counted(rows: DataFrame) -> DataFrame:
    """term, n1, n0: rows of either label with the term; and a row with term null for all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = (Counter(), Counter())
        for df in batches:
            for text, toxic in zip(df["text"], df["toxic"], strict=True):
                both[int(toxic == 1)].update(terms_of(text or ""))
                both[int(toxic == 1)][None] += 1
            # no term that only clean rows have is ever chosen; counts of the others are complete after the sum
            yield pd.DataFrame([(t, both[1][t], both[0][t]) for t in both[0].keys() | both[1].keys()], columns=["term", "n1", "n0"])
            both[0].clear()
            both[1].clear()

    return rows.mapInPandas(tidy(run), "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def chosen(counts: DataFrame) -> tuple[dict[str, float], int, int]:
    """(term -> log odds, rows of label 1, of label 0)."""
    kept = counts.where(F.col("term").isNull() | (F.col("n1") >= LEAST_ROWS)).persist()
    total = kept.where("term is null").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    if not n1 or not n0:
        kept.unpersist()
        return {}, n1, n0
    p, q, base = F.col("n1"), F.col("n0"), n1 / (n1 + n0)
    # the likelihood ratio of the term's own share of label 1 against the base share
    gain = 2 * (p * F.log(p / ((p + q) * base)) + F.when(q > 0, q * F.log(q / ((p + q) * (1 - base)))).otherwise(0.0))
    precise = (p / n1) / (p / n1 + q / n0) >= LEAST_PRECISION
    terms = kept.where("term is not null")
    chance = 2 * math.log(max(2, terms.count()))
    rows = terms.withColumn("gain", gain).where(precise & (F.col("gain") >= chance)).orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(TERMS).collect()
    kept.unpersist()
    out: dict[str, float] = {}
    rows_of: dict[str, int] = {}
    for r in rows:
        term, plain = r["term"], r["term"].rstrip("*")
        weight = math.log((r["n1"] + 0.5) / (n1 + 1)) - math.log((r["n0"] + 0.5) / (n0 + 1))
        above = [plain[:k] + "*" for k in BEGINNINGS if k < len(plain) or (k == len(plain) and term == plain)]
        if any(x in out and (weight < out[x] + CLEARER or r["n1"] < rows_of[x] / 10) for x in above):
            continue  # a beginning that is no worse has its rows
        if term != plain and sum(n for t, n in rows_of.items() if t.startswith(plain)) >= COVERED * r["n1"]:
            continue  # longer terms that are better evidence have most of its rows
        out[term] = weight
        rows_of[term] = r["n1"]
    return out, n1, n0


# --- automaton --------------------------------------------------------------------------------------------------------


def quotations(text: str) -> list[tuple[int, int]]:
    """The places of what stands in quotation marks, in one pass, however long it is. What is never closed is no quotation."""
    out: list[tuple[int, int]] = []
    opened: dict[str, int] = {}  # closing sign -> where its quotation began
    for m in SIGNS.finditer(text):
        sign = m.group()
        if sign in opened:
            out.append((start := opened[sign], m.end()))
            opened = {k: v for k, v in opened.items() if v != start}
        elif sign in QUOTES:
            opened |= dict.fromkeys(QUOTES[sign], m.start())
        elif sign[0] == "\n":
            opened.pop('"', None)
    return out


def edits(term: str) -> int:
    n = len(term.rstrip("*"))
    return 0 if n < 5 or term.endswith("*") and n < 6 else 1 if n < 9 else 2


class Automaton:
    """The product of the lexicon's trie and its terms' Levenshtein automata, made deterministic as it is used.

    A state is a set of (trie node, edits so far); a step reads a letter: it matches a child, replaces it, is inserted, or
    children are skipped (deleted). Beginnings accept as soon as they are read, whatever follows."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.weights = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.most: list[int] = [0]  # edits that some term below still allows
        for term in sorted(terms):
            node, k = 0, edits(term)
            self.most[0] = max(self.most[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append(term)
        self.steps: dict[tuple[int, str], int] = {}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.found: list[tuple] = []  # best whole word, best beginning
        self.dead = self.state(set())
        self.start = self.state({(0, 0)})

    def state(self, members: set[tuple[int, int]]) -> int:
        todo = list(members)
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.most[child] and (child, e + 1) not in members:
                    members.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in members:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            whole = [(e, -self.weights[t], t) for node, e in key for t in self.ends[node] if not t.endswith("*") and e <= edits(t)]
            begin = [(e, -self.weights[t], t) for node, e in key for t in self.ends[node] if t.endswith("*") and e <= edits(t)]
            self.found.append((min(whole, default=None), min(begin, default=None)))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.members[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e < self.most[node]:
                after.add((node, e + 1))
            after.update((child, e + 1) for child in self.children[node].values() if e < self.most[child])
        self.steps[state, c] = out = self.state(after)
        return out

    def match(self, word: str) -> tuple[int, float, str] | None:
        """(edits, minus weight, term) of the best match of a word."""
        state, best, steps = self.start, None, self.steps
        for c in word:
            nxt = steps.get((state, c))
            state = self.step(state, c) if nxt is None else nxt
            if state == self.dead:
                return best
            begin = self.found[state][1]
            if begin and (best is None or begin < best):
                best = begin
        whole = self.found[state][0]
        return min(x for x in (best, whole) if x) if best or whole else None


class Scorer:
    def __init__(self, terms: dict[str, float], ignored: frozenset[str] = frozenset()) -> None:
        self.automaton, self.terms, self.ignored = Automaton(terms), terms, ignored
        self.cache: dict[str, tuple[int, str] | None] = {}

    def match(self, word: str) -> tuple[int, str] | None:
        """The match of a word, itself or with look-alike signs read as letters."""
        if word in self.ignored:
            return None
        found = self.automaton.match(word)
        if (not found or found[0]) and not word.isalpha() and not word.isdigit():
            other = self.automaton.match(word.translate(LEET))
            found = min((x for x in (found, other and (max(1, other[0]), *other[1:])) if x), default=None)
        return found and (found[0], found[2])

    def matches(self, text: str) -> list[tuple[int, str, int, str]]:
        """(token's number, word, edits, term)."""
        if not self.terms:
            return []
        words, cache = TOKEN.findall(text.lower()), self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        if len(self.automaton.steps) > STEPS:  # states are made as words need them; a worker keeps so many
            self.automaton = Automaton(self.terms)
        hits = set()
        for w in set(words):
            if w not in cache:
                cache[w] = self.match(w)
            if cache[w]:
                hits.add(w)
        return [(i, w, *cache[w]) for i, w in enumerate(words) if w in hits] if hits else []

    def counts(self, text: str) -> tuple[int, dict[str, float], list[str]]:
        """Words of the text, each matched term's count as its context weighs it, and the words matched with edits."""
        hits = self.matches(text)
        if not hits:
            return len(TOKEN.findall(text)), {}, []
        low = text.lower()
        tokens = list(TOKEN.finditer(low))
        quoted = quotations(low) if any(c in low for c in QUOTES) else []
        out: dict[str, float] = {}
        for i, _, e, term in hits:
            near = {t.group() for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
            start = tokens[i].start()
            factor = 1.0
            if any(a < start < b for a, b in quoted):
                factor = 0.25 if near & REPORTING else 0.6
            elif near & ADDRESS:
                factor = 1.25
            out[term] = out.get(term, 0.0) + factor / 2**e
        return len(tokens), out, [w for _, w, e, _ in hits if e]


def features(n: int, counts: dict[str, float], rates: dict[str, float]) -> list[float]:
    """How far the terms' counts exceed what clean texts of n words have (Poisson deviance): in sum, at most, squared, in how many terms."""
    over = []
    for term, c in counts.items():
        if term not in rates:
            continue
        usual = rates[term] * (n + 20)
        if c > usual:
            over.append(c * math.log(c / usual) - c + usual)
    total, top = sum(over), max(over, default=0.0)
    return [math.log1p(total), math.log1p(top), math.log1p(total) ** 2 / 4, sum(x > 2 for x in over) / 4]


# --- model ------------------------------------------------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method. Only the constant is free of the penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * len(x))
    penalty[-1] = 1e-6 * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, float], ignored: frozenset[str], rates: dict[str, float], weights: list[float] | None, share: float) -> None:
        self.terms, self.ignored, self.rates, self.weights, self.share = terms, ignored, rates, weights, share

    def score(self, n: int, counts: dict[str, float]) -> float:
        if self.weights is None:
            return self.share
        z = sum(a * b for a, b in zip([*features(n, counts, self.rates), 1.0], self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    every = training_rows(docs, labels).persist()
    rows = without_copies(every).persist()
    terms, n1, n0 = chosen(counted(rows))
    every.unpersist()
    if not terms:
        rows.unpersist()
        return Model({}, frozenset(), {}, None, n1 / max(1, n1 + n0))

    def sampled(ignored: frozenset[str]) -> list:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(terms, ignored)
            for df in batches:
                got = [scorer.counts(t or "") for t in df["text"]]
                yield pd.DataFrame({"n": [n for n, _, _ in got], "counts": [list(c.items()) for _, c, _ in got], "words": [w for *_, w in got], "toxic": (df["toxic"] == 1).astype("int32").values})

        return rows.mapInPandas(tidy(run), "n long, counts array<struct<term: string, c: double>>, words array<string>, toxic int").collect()  # TRAIN_ROWS rows at most

    by = (Counter(), Counter())
    for r in (sample := sampled(frozenset())):
        by[r["toxic"]].update(set(r["words"]))
    # a word near a term that clean rows use is a word of its own
    ignored = frozenset(w for w, n in by[0].items() if by[1][w] / n1 <= 9 * n / n0)
    if ignored:
        sample = sampled(ignored)
    rows.unpersist()
    words, seen = [0, 0], (Counter(), Counter())
    for r in sample:
        words[r["toxic"]] += r["n"]
        seen[r["toxic"]].update({x["term"]: x["c"] for x in r["counts"]})
    rates = {t: (seen[0][t] + 0.5) / (words[0] + 1) for t in terms}
    # a beginning whose toxic words all match better terms is left with words that say nothing
    rates = {t: rate for t, rate in rates.items() if (seen[1][t] + 0.5) / (words[1] + 1) >= LIFT * rate}
    x = np.array([features(r["n"], {c["term"]: c["c"] for c in r["counts"]}, rates) for r in sample])
    return Model(terms, ignored, rates, logistic(x, np.array([r["toxic"] for r in sample], float)).tolist(), n1 / (n1 + n0))


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of docs, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.ignored)
        for batch in batches:
            scores = [model.score(*scorer.counts(t or "")[:2]) for t in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    out = docs.select(*columns, F.col("text").alias("_scored")).mapInArrow(tidy(run), f"{fields}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts toxic, all columns as they are."""

    def run(batches):
        scorer = Scorer(model.terms, model.ignored)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([model.score(*scorer.counts(t or "")[:2]) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
