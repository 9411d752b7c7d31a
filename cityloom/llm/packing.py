"""Op 2: best-fit packing of token pieces by exact-complement hashing.

Tokenization makes thin piece rows; only texts longer than a sequence are cut. What is planned is the histogram of piece
lengths, which the sequence length bounds: the largest length that is left opens a sequence, and its gap is looked up among
the sums of one, two and three lengths that are still available; where no sum closes it exactly, the best-fitting (largest)
length goes in and the rest of the gap is looked up again. A combination is used as often as its scarcest length allows, so
the plan has at most about one pattern a length, however many rows there are.

Pieces get ranks among the pieces of their length from prefix sums over a fixed number of buckets and a ranking inside each,
so a length that a third of all rows share is spread. A rank's place in the plan is a binary search in a bounded table.

Cases: a null or empty text is one piece that holds just the closing id; repeated rows are packed as often as they stand; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.llm.common import for_pandas, ids_of, settled, table, tidy
from cityloom.llm.tokens import VOCABULARY, Tokens

LENGTH = 4096
CLOSING = 1
BUCKETS = 256
#: Places (length, rank) as one number: more rows of a length than this are not foreseen.
RANKS = 1 << 44

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids; with_ids: and the ids, as little-endian unsigned 32-bit bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(path)
        closing = np.array([CLOSING], "<u4").tobytes()
        for df in batches:
            rows = []
            # texts go to the tokenizer a few at a time, so that one batch of long ones stays small
            ids, texts = ids_of(df), ["" if t is None else t for t in df["text"].tolist()]
            for at in range(0, len(ids), 256):
                for doc_id, data in zip(ids[at : at + 256], tokens.of(texts[at : at + 256]), strict=True):
                    data += closing
                    for k in range(0, len(data), 4 * length):
                        part = data[k : k + 4 * length]
                        rows.append((doc_id, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame([r[1:] for r in rows], columns=["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], "Int64"))
            yield out

    return for_pandas(docs, "text").mapInPandas(tidy(run), PIECES + (", ids binary" if with_ids else ""))


class Lengths:
    """How many pieces of each length are left, and which sums they make."""

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.left, self.length = Counter({k: n for k, n in counts.items() if n > 0}), length
        self.mask = sum(1 << k for k in self.left)
        self.mirror = sum(1 << (length - k) for k in self.left)  # bit length - k, to meet the mask at k + k' = gap

    def take(self, pattern: list[int]) -> int:
        """As many sequences of the pattern as there can be; their pieces are gone."""
        need = Counter(pattern)
        times = min(self.left[k] // n for k, n in need.items())
        for k, n in need.items():
            self.left[k] -= times * n
            if not self.left[k]:
                del self.left[k]
                self.mask ^= 1 << k
                self.mirror ^= 1 << (self.length - k)
        return times

    def can(self, used: Counter, more: tuple[int, ...]) -> bool:
        need = Counter(more)
        return all(self.left[k] >= used[k] + n for k, n in need.items())

    def largest(self, most: int, used: Counter) -> int:
        mask = self.mask & ((1 << (most + 1)) - 1)
        while mask:
            k = mask.bit_length() - 1
            if self.left[k] > used[k]:
                return k
            mask ^= 1 << k
        return 0

    def pair(self, gap: int, used: Counter) -> tuple[int, ...]:
        """Two lengths that sum to the gap, the larger as large as can be."""
        both = self.mask & (self.mirror >> (self.length - gap)) if gap <= self.length else 0
        both &= (1 << gap) - 1
        while both:
            k = both.bit_length() - 1
            if 2 * k < gap:
                return ()
            if self.can(used, (k, gap - k)):
                return k, gap - k
            both ^= 1 << k
        return ()

    def closing(self, gap: int, used: Counter) -> tuple[int, ...]:
        """One, two or three lengths that fill the gap exactly."""
        if self.mask >> gap & 1 and self.can(used, (gap,)):
            return (gap,)
        if found := self.pair(gap, used):
            return found
        mask = self.mask & ((1 << max(0, gap - 1)) - 1)
        while mask:
            k = mask.bit_length() - 1
            if 3 * k < gap:
                break
            if self.left[k] > used[k] and (two := self.pair(gap - k, used + Counter((k,)))) and self.can(used, (k, *two)):
                return k, *two
            mask ^= 1 << k
        return ()


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), covering all pieces."""
    out, left = [], Lengths(counts, length)
    while left.left:
        pattern = [left.largest(length, Counter())]
        while gap := length - sum(pattern):
            used = Counter(pattern)
            if found := left.closing(gap, used):
                pattern += found
            elif best := left.largest(gap, used):
                pattern.append(best)
            else:
                break
        out.append((pattern, left.take(pattern)))
    return out


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first sequence, offset), by key = length * RANKS + first rank: which ranks of a length go where."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for k in pattern:
            rows.append((k * RANKS + taken[k], sequence, offset))
            taken[k] += times
            offset += k
        sequence += times
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, first, offset


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (a settled table with doc_id, piece, length and more) -> with sequence_id and offset."""
    thin = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    sums = thin.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `length` rows
    key, first, offset = places(plan(counts, length))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = thin.join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + rank - 1).select(*pieces.columns, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, rank = batch.columns
            own = batch.column("length").to_numpy() * RANKS + rank.to_numpy()
            at = np.searchsorted(key, own, "right") - 1
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + own - key[at]), pa.array(offset[at])], names)

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(run), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """Packed pieces that carry ids -> a row a sequence: sequence_id, its ids, its documents. A sequence's length bounds the group."""
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_parts"))
    joined = F.expr("aggregate(_parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return whole.select("sequence_id", joined.alias("ids"), F.col("_parts.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    return packed(settled(cut_pieces(docs, path, length), "pieces"), length)


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
