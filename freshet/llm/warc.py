"""WARC in ZIP packages: a writer, and a reader that never extracts anything.

A package is a ZIP file whose members are *stored* (not compressed by the ZIP): the WARC
files, each a run of gzip members with one record in each, and for each WARC file an index of
JSON lines. As stored members lie in the package byte for byte, a record is found at
``member offset + record offset`` and read by one range request.

Reading: the end-of-central-directory record is searched in the file's tail, the ZIP64 locator
and record are followed where it refers to them, the central directory is parsed with its ZIP64
extra fields, the local header of each wanted member gives the place of its bytes, the index
members list the records, and the records are read range by range, in parallel over all
packages and records.

Equal payloads: of the records with one payload of at least ``least`` bytes, that of the
smallest id is a ``response``; all others are ``revisit`` records that refer to it and hold no
payload. Shorter payloads are always written in full.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path, spread, struct_of, with_minimum
from .files import RangeReader, written

#: Fixed values of the ZIP format: signatures and the sizes of its fixed parts.
EOCD, EOCD_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
EOCD64, EOCD64_SIZE = b"PK\x06\x06", 56
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
ZIP64_EXTRA, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF
LONGEST_COMMENT = 65_535

INDEX = struct_of(("package", T.StringType()), ("member", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))
RECORD = struct_of(
    ("package", T.StringType()),
    ("headers", T.MapType(T.StringType(), T.StringType())),
    ("record_type", T.StringType()),
    ("payload", T.BinaryType()),
)


# -- ZIP directories -------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def central_directory(files: RangeReader, uri: str) -> list[Member]:
    """All members of the ZIP at uri, from its directories alone."""
    end = files.size(uri)
    tail_at = max(0, end - EOCD_SIZE - LONGEST_COMMENT)
    tail = files.read(uri, tail_at, end - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0:  # a comment may hold the signature: the true record's comment ends the file
        if len(tail) - at >= EOCD_SIZE and at + EOCD_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError(f"{uri}: no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == FULL16 or size == FULL32 or start == FULL32:
        where = tail_at + at - LOCATOR_SIZE
        if where >= 0 and (locator := files.read(uri, where, LOCATOR_SIZE))[:4] == LOCATOR:
            record = files.read(uri, struct.unpack_from("<Q", locator, 8)[0], EOCD64_SIZE)
            if record[:4] != EOCD64:
                raise ValueError(f"{uri}: broken ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, p = files.read(uri, start, size), [], 0
    for _ in range(count):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError(f"{uri}: broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, p + 16)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + CENTRAL_SIZE : p + CENTRAL_SIZE + n_name]
        extra = directory[p + CENTRAL_SIZE + n_name : p + CENTRAL_SIZE + n_name + n_extra]
        wide = _zip64_field(extra)
        if full == FULL32:
            full, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if packed == FULL32:
            packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if header == FULL32:
            header = struct.unpack_from("<Q", wide)[0]
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, crc, packed, full, header))
        p += CENTRAL_SIZE + n_name + n_extra + n_comment
    return members


def _zip64_field(extra: bytes) -> bytes:
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == ZIP64_EXTRA:
            return extra[p + 4 : p + 4 + n]
        p += 4 + n
    return b""


def data_offset(files: RangeReader, uri: str, member: Member) -> int:
    """Where the bytes of a stored member begin in the package."""
    if member.method != 0 or member.packed != member.size:
        raise ValueError(f"{uri}: member {member.name} isn't stored")
    head = files.read(uri, member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"{uri}: no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra


def index_rows(files: RangeReader, uri: str, step: int = 1 << 20) -> Iterator[tuple[str, int, int]]:
    """(member, offset in the package, length) of every record that the package's indexes list."""
    members = {m.name: m for m in central_directory(files, uri)}
    for name, member in members.items():
        if not (name.startswith("indexes/") and name.endswith(".jsonl")):
            continue
        at, left, rest = data_offset(files, uri, member), member.size, b""
        bases: dict[str, int] = {}
        while left or rest:
            chunk = files.read(uri, at, min(step, left))
            at, left = at + len(chunk), left - len(chunk)
            *lines, rest = (rest + chunk).split(b"\n") if left else [*(rest + chunk).split(b"\n"), b""]
            for line in filter(None, lines):
                row = json.loads(line)
                archive = f"archive/{row['filename']}"
                if archive not in bases:
                    bases[archive] = data_offset(files, uri, members[archive])
                yield archive, bases[archive] + row["offset"], row["length"]


# -- WARC records ----------------------------------------------------------------------------


def pack_record(headers: dict[str, str], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def unpack_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record_for(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The record of one page; a line break in a URL can't stand in a header and is escaped."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": urn(page_id), "WARC-Date": "1970-01-01T00:00:00Z"}
    if target:
        headers["WARC-Target-URI"] = target
    headers |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(refers_to)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return pack_record(headers, http + (payload if refers_to is None else b""))


class PackageWriter:
    """Writes packages of bounded size, one after another."""

    def __init__(self, folder: str, stem: str, most: int):
        self.folder, self.stem, self.most, self.n = folder, stem, most, 0
        self.out = None

    def _begin(self) -> None:
        self.name = f"{self.stem}-{self.n:04d}"
        self.uri = f"{self.folder}/{self.name}.wacz"
        self.context = written(self.uri)
        self.zip = zipfile.ZipFile(self.context.__enter__(), "w", zipfile.ZIP_STORED, allowZip64=True)
        info = zipfile.ZipInfo(f"archive/{self.name}.warc.gz")
        self.out = self.zip.open(info, "w", force_zip64=True)
        self.lines, self.at, self.n = [], 0, self.n + 1

    def add(self, record: bytes) -> str | None:
        """The package's uri once it is full."""
        if self.out is None:
            self._begin()
        self.out.write(record)
        self.lines.append(json.dumps({"filename": f"{self.name}.warc.gz", "offset": self.at, "length": len(record)}))
        self.at += len(record)
        return self.end() if self.at >= self.most else None

    def end(self) -> str | None:
        if self.out is None:
            return None
        self.out.close()
        self.zip.writestr(zipfile.ZipInfo(f"indexes/{self.name}.jsonl"), "\n".join(self.lines) + "\n")
        self.zip.close()
        self.context.__exit__(None, None, None)
        self.out = None
        return self.uri


# -- DataFrames ------------------------------------------------------------------------------


def write_packages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", body: str = "html", least: int = 100, most: int = 64 << 20) -> DataFrame:
    """Write a record for every row into ZIP packages below folder; returns their uris.

    A null body is the empty payload. A repeated row whose id is the smallest of its payload is
    a response each time. A null id takes part in nothing but its own response record.

    Which pages are revisits is decided on ids and digests alone, those of one payload dealt out
    over many tasks; payloads then meet that decision by their page's id and digest, or, if the
    revisits are few enough for Spark to broadcast them, stay where they are.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("key"))
    first = with_minimum(known, "key", "page_id", "refers_to", ["page_id"]).where("refers_to < page_id").distinct()
    first = materialize(first.select("page_id", F.lower(F.hex("key")).alias("digest"), "refers_to"), "revisits")
    marked = rows.join(first, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = PackageWriter(folder, f"part-{TaskContext.get().partitionId():06d}", most)
        for batch in batches:
            done = [writer.add(record_for(*row)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pydict({"package": pa.array([x for x in done if x], pa.string())})
        last = writer.end()
        yield pa.RecordBatch.from_pydict({"package": pa.array([last] if last else [], pa.string())})

    return materialize(marked.mapInArrow(run, struct_of(("package", T.StringType()))), "packages")


def read_index(packages: DataFrame) -> DataFrame:
    """One row for each record that the packages' index members list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RangeReader()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for row in index_rows(files, uri):
                    rows.append((uri, *row))
                    if len(rows) == 10_000:
                        yield _index_batch(rows)
                        rows = []
                yield _index_batch(rows)
        files.close()

    return packages.select("package").mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=INDEX.names)


def read_records(index: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Range-read every record of the index; payloads are those of the records, empty for a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RangeReader()
        for batch in batches:
            rows, held = [], 0
            for uri, _, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers, block = unpack_record(files.read(uri, offset, length))
                payload = block.partition(b"\r\n\r\n")[2]
                rows.append((uri, list(headers.items()), headers.get("WARC-Type"), payload))
                held += len(payload)
                if held >= most:
                    yield _record_batch(rows)
                    rows, held = [], 0
            yield _record_batch(rows)
        files.close()

    return index.mapInArrow(run, RECORD)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=RECORD.names)


def digests(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, read
    from the packages. The digest of a response is computed from its payload; one that differs
    from its header is an error."""
    schema = struct_of(("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RangeReader()
        for batch in batches:
            rows = []
            for uri, _, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers, block = unpack_record(files.read(uri, offset, length))
                kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != said or len(payload) != int(headers["X-Payload-Length"]):
                        raise ValueError(f"{uri}: record at {offset} is damaged")
                rows.append((page_of(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), said, kind, page_of(headers.get("WARC-Refers-To"))))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)
        files.close()

    return index.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as ZIP-packaged WARC, read the packages back, one row a page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    packages = write_packages(pages, scratch_path(spark, "warc"))
    index = read_index(packages.repartition(spread(spark), "package"))
    return digests(index.repartition(spread(spark)))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
