"""Op 1: WARC records in ZIP packages, written and range-read back.

A package is a ZIP file of stored members: archive/data.warc.gz (one gzip member a record), indexes/index.cdxj and
datapackage.json, with ZIP64 records throughout, so that size sets no limit. The reader takes no library for ZIP: it reads
the end of the file, follows the ZIP64 locator, parses the central directory, finds the members' data, reads the index by
range, and then each record by the range that the index names; nothing is unpacked.

Packages lie in the shared folder. A task closes one when it has PACKAGE_BYTES of compressed records, so memory is bounded;
file names are a task attempt's own, and only packages in the table that the writing job commits are read, so lost
executors and second attempts leave no trace in the result.

Of records with equal payloads (by SHA-1) of at least min_bytes bytes, the one with the largest page_id is a response, the
others are revisits without payload. The winners are aggregated map-side; joining them to the pages is an equi-join that
adaptive execution splits where one payload is frequent.

Cases: a null html is an empty payload; a null url or page_id is left out of the record; a row that repeats the response's
page_id is a response too; rows without page_id revisit the group's response, or are responses in a group that has no id;
an empty table writes no package; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.common import new_path, settled, table, tidy, utf8

PACKAGE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TAIL = 66_000  # the end record, its longest comment, the ZIP64 locator and record
LONG, SHORT = 0xFFFFFFFF, 0xFFFF


# --- files ------------------------------------------------------------------------------------------------------------


def file_system(uri: str):
    """(file system, path in it) of a file:, hdfs:, s3: ... URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    where, path = file_system(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(data)


class Ranges:
    """Reads byte ranges of a file."""

    def __init__(self, uri: str) -> None:
        where, path = file_system(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


# --- ZIP --------------------------------------------------------------------------------------------------------------


def zip_package(members: list[tuple[str, bytes]]) -> bytes:
    """Stored members, with ZIP64 sizes, places and end records."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, n = len(out), zlib.crc32(data), name.encode()
        out += struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, LONG, LONG, len(n), 20) + n
        out += struct.pack("<2H2Q", 1, 16, len(data), len(data)) + data
        central += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, LONG, LONG, len(n), 28, 0, 0, 0, 0, LONG) + n
        central += struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
    start, end = len(out), len(out) + len(central)
    out += central
    out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), start)
    out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, SHORT, SHORT, LONG, LONG, 0)
    return bytes(out)


def zip_members(ranges: Ranges) -> dict[str, tuple[int, int, int, int]]:
    """name -> (place of the local header, stored size, method, crc) from the central directory."""
    tail_at = max(0, ranges.size - TAIL)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    end = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        record = ranges.read(place, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points at no end record")
        count, size, start = struct.unpack_from("<3Q", record, 32)
    directory, at, out = ranges.read(start, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, crc, packed, plain, n, extra, comment, header = *struct.unpack_from("<H4xI2I3H", directory, at + 10), struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode()
        more = directory[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            kind, length = struct.unpack_from("<2H", more)
            if kind == 1:  # in this order, each only where the field before is full
                wide = iter(struct.unpack_from(f"<{length // 8}Q", more, 4))
                plain = next(wide) if plain == LONG else plain
                packed = next(wide) if packed == LONG else packed
                header = next(wide) if header == LONG else header
            more = more[4 + length :]
        out[name] = (header, packed, method, crc)
        at += 46 + n + extra + comment
    return out


def data_place(ranges: Ranges, header: int) -> int:
    """Where a stored member's bytes begin: the local header's name and extra may differ from the directory's."""
    local = ranges.read(header, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError("no local header")
    return header + 30 + sum(struct.unpack_from("<2H", local, 26))


# --- WARC -------------------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; refers_to: a revisit's response. A revisit keeps the response's HTTP header, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    own = uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id} {digest_of(payload)}") if page_id is None else f"page:{page_id}"
    head.append(f"WARC-Record-ID: <urn:{'uuid:' if page_id is None else ''}{own}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, body) of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    if warc.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest_of(block)):
        raise ValueError("block digest differs")
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, body


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


# --- operator ---------------------------------------------------------------------------------------------------------


def with_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and refers_to: the page that a revisit revisits, else null."""
    payload = utf8(F.col("html"))
    digest = F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload))
    groups = pages.select("page_id", digest.alias("_digest")).where("_digest is not null").groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    met = pages.select("page_id", "url", "html", digest.alias("_digest")).join(groups.where("_n > 1").drop("_n"), "_digest", "left")
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, min_bytes: int = 0) -> DataFrame:
    """Writes packages of pages' records -> the table of them: package, records, bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, made = uuid.uuid4().hex, 0
        data, index = bytearray(), []

        def package() -> pd.DataFrame:
            nonlocal made, data, index
            lines = "".join(f"{json.dumps(x)}\n" for x in index).encode()
            about = json.dumps({"profile": "data-package", "resources": [{"path": WARC_MEMBER, "bytes": len(data)}, {"path": INDEX_MEMBER, "bytes": len(lines)}]}).encode()
            path = f"{folder}/{own}-{made:05d}.wacz"
            write_file(path, whole := zip_package([(WARC_MEMBER, bytes(data)), (INDEX_MEMBER, lines), ("datapackage.json", about)]))
            out = pd.DataFrame({"package": [path], "records": [len(index)], "bytes": [len(whole)]})
            made, data, index = made + 1, bytearray(), []
            return out

        for df in batches:
            for page_id, url, html, refers in zip(*(df[c].tolist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, refers = (None if x is None or x != x else int(x) for x in (page_id, refers))
                packed = gzip.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers), 6, mtime=0)
                index.append({"url": url, "offset": len(data), "length": len(packed)})
                data += packed
                if len(data) >= package_bytes:
                    yield package()
        if index:
            yield package()

    # ids as text: a column with nulls would pass through pandas as floating point
    rows = with_responses(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(tidy(run), "package string, records long, bytes long")


def read_index(packages: DataFrame) -> DataFrame:
    """packages (package) -> a row a record: package, its first byte in the package, length, url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for package in df["package"]:
                ranges = Ranges(package)
                members = zip_members(ranges)
                header, size, method, crc = members[INDEX_MEMBER]
                if method or members[WARC_MEMBER][2]:
                    raise ValueError(f"{package}: members must be stored")
                lines = ranges.read(data_place(ranges, header), size)
                if zlib.crc32(lines) != crc:
                    raise ValueError(f"{package}: the index is damaged")
                first = data_place(ranges, members[WARC_MEMBER][0])
                ranges.close()
                rows = [(package, first + x["offset"], x["length"], x["url"]) for x in map(json.loads, lines.splitlines())]
                yield pd.DataFrame(rows, columns=["package", "start", "length", "url"])

    return packages.select("package").mapInPandas(tidy(run), "package string, start long, length long, url string")


RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
READ_AT_ONCE = 4 << 20
TASK_BYTES = 4 << 20


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Range-reads the records of an index; neighbours in a package by one read of READ_AT_ONCE bytes at most."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for package, part in df.sort_values(["package", "start"]).groupby("package", sort=False):
                ranges = Ranges(package)
                held, held_at = b"", 0
                starts, lengths = part["start"].tolist(), part["length"].tolist()
                for i, (start, length) in enumerate(zip(starts, lengths, strict=True)):
                    if not (held_at <= start and start + length <= held_at + len(held)):
                        j = i
                        while j + 1 < len(starts) and starts[j + 1] == starts[j] + lengths[j] and starts[j + 1] + lengths[j + 1] - start <= READ_AT_ONCE:
                            j += 1
                        held, held_at = ranges.read(start, starts[j] + lengths[j] - start), start
                    warc, http, body = parsed(gzip.decompress(held[start - held_at : start - held_at + length]))
                    kind, digest, n = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    if kind == "response" and (len(body) != n or digest_of(body) != digest):
                        raise ValueError(f"{package} at {start}: the payload is damaged")
                    page, refers = page_of(warc["warc-record-id"]), page_of(warc.get("warc-refers-to"))
                    rows.append((None if page is None else str(page), warc.get("warc-target-uri"), n, digest, kind, None if refers is None else str(refers), *([body] if with_payload else [])))
                ranges.close()
            yield pd.DataFrame(rows, columns=names)

    out = index.select("package", "start", "length").mapInPandas(tidy(run), RECORDS + (", payload binary" if with_payload else ""))
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of a settled table of packages (package, records, bytes). Rows of few bytes that stand for much work are dealt out by
    number, which adaptive execution leaves as it is: a task for each TASK_BYTES of packages."""
    many, size = packages.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    index = read_index(packages.repartition(max(1, many)))
    return read_records(index.repartition(max(1, -(-size // TASK_BYTES)), "package", F.expr(f"start div {READ_AT_ONCE}")))


def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = settled(write_packages(table(spark, sf_dir, "pages"), new_path(spark, "warc")), "packages")
    records = read_packages(packages)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
