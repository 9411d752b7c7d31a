"""Op 10: secret scans, with patterns for the plain kinds and dictionary-primed zstandard novelty for the rest.

The base kinds are patterns. Beyond them, a string in sensitive context (a word such as key or bearer shortly before it) is
measured: zstandard is primed with the text around it, itself left out, and with a dictionary of common identifiers, and the
bytes that the string then adds are its novelty. Repeated values cost next to nothing, identifiers and paths mostly less than
their size; what stays near the size of random characters is reported as kind "novel". Spans are code points, end exclusive, of the whole match.

Cases: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import for_pandas, ids_of, table, tidy

# Fixed values of the contract: the base patterns, and what a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a longest run of 16 and more is just what [0-9a-f]+ finds there
KINDS = ("assign", "access", "hex", "novel")

#: A string that may be a secret: a long run of key characters with a digit and a letter in it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"secret|token|passw|passphrase|credential|bearer|authori[sz]ation|private|signature|api.?key|access.?key|\bkey\b|\bpwd\b|\bauth\b", re.IGNORECASE)
BEFORE, AROUND = 64, 512
#: Bytes a character. zstandard leaves the literals of short strings as they are, so random ones cost all their bytes, while each
#: word found in the dictionary or nearby saves some; from LONG characters on random hexadecimal digits need 0.58, base64 0.9.
SHORT_RATIO, LONG_RATIO, LONG = 0.9, 0.55, 64
IDENTIFIERS = " ".join(
    "abstract access account address application argument array async authorization await bearer boolean bucket buffer cache callback certificate "
    "class client cluster column config configuration connect const container context controller credential database default delete description "
    "development directory document element endpoint environment error event exception export false field file filter float format function "
    "handler header host http https identifier implementation import index integer interface internal iterator json key length library license "
    "list local localhost logger manager message method model module name namespace null number object option package parameter parse password "
    "path pattern payload permission pipeline port private process production property protocol provider public query queue random record "
    "region registry release request resource response result return role route schema script secret sequence server service session setting "
    "signature snapshot source staging state static status storage stream string struct subscription table target task template test thread "
    "timestamp token transaction true type undefined update upload user username validate value variable vector version worker workspace "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef xxxxxxxxxxxxxxxx 0000000000000000"
    .split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, unsorted."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Novelty:
    """Marginal compressed bytes of a string, given the text around it."""

    def __init__(self) -> None:
        import zstandard

        self.zstd = zstandard
        self.empty = len(self.primed(b"").compress(b""))

    def primed(self, around: bytes):
        words = self.zstd.ZstdCompressionDict(IDENTIFIERS.encode() + b" " + around, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        return self.zstd.ZstdCompressor(level=3, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, text: str, start: int, end: int) -> int:
        around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        return len(self.primed(around.encode("utf-8", "replace")).compress(text[start:end].encode())) - self.empty


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if any(start < e and s < end for s, _, e in base) or not SENSITIVE.search(text, max(0, start - BEFORE), start):
            continue
        cost = novelty.of(text, start, end)
        if cost >= (SHORT_RATIO if end - start < LONG else LONG_RATIO) * (end - start):
            out.append((start, 3, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for df in batches:
            rows = []
            for text in df["text"]:
                text = text or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            out.insert(0, "doc_id", pd.array(ids_of(df), "Int64"))
            yield out

    return for_pandas(docs, "text").mapInPandas(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


MASK = "[secret]"


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by MASK; overlapping spans by one. n_chars, where there, is of the new text."""

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else masked(t, base := base_spans(t), novel_spans(t, base, novelty)) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def masked(text: str, base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, _, end in sorted(base + more):
        if end <= at:
            continue
        out += [text[at:start], MASK] if start >= at else []
        at = end
    return "".join(out) + text[at:]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
