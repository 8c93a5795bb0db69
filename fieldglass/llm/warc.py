"""Operator 4: WARC archives as a PySpark Python data source.

`spark.read.format("warc")` plans partitions of whole files, takes predicates on the record
type and the other header columns, reads a record's headers first and leaves the payloads of
unwanted records undecoded: our gzip members carry their compressed size in an extra field
('sl'), so a skipped member is not even inflated. Files of other writers (plain or gzip)
are read as well. Every job writes files of unique names and, on commit, a manifest of its
own; readers take the files of all manifests, so leftovers of failed attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from fieldglass.llm.common import join_hot, scratch_path, short_batches, stage

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, payload_length long, content_length long, headers map<string,string>, payload binary"
)
MANIFEST = re.compile(r"_manifest-[0-9a-f]+\.json$")
#: Says that the target URI is percent-encoded, since it does not fit a header line as it is.
ENCODED = "X-Target-URI-Encoding"
#: The extra field of a gzip member holds sizes below this.
MAX_MEMBER = 1 << 32
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
#: Bytes of files in one read partition, of one written file, and of payloads in one Arrow batch.
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 256 << 20, 8 << 20
CHUNK = 1 << 16
GZIP_LEVEL = 4


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing ----------------------------------------------------------------------------


def one_line(uri: str) -> bool:
    """Whether a header line gives the URI back as it is."""
    return uri == uri.strip() and not re.search(r"[\x00-\x1f\x7f\x85\u2028\u2029]", uri)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, digest: str, length: int) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines[3:3] = [f"WARC-Target-URI: {uri}"] if one_line(uri) else [f"WARC-Target-URI: {quote(uri, safe='/:?&=')}", f"{ENCODED}: percent"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' holds its own size and its content's; one too large for the field has none."""
    squeeze = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) < MAX_MEMBER:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, refers_to, payload, payload_sha1, payload_length.

    payload_sha1 and payload_length may be null where the payload is there. Mode append adds to
    what the folder holds, overwrite replaces it.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files: list[str] = []
        out, room = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                payload = r["payload"] or b""
                digest = base64.b32encode(r["payload_sha1"]).decode() if r["payload_sha1"] else digest32(payload)
                length = len(payload) if r["payload_length"] is None else r["payload_length"]
                data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], payload, digest, length))
                if out is None or room < len(data):
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, room = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), FILE_BYTES
                out.write(data)
                room -= len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        before = fs.get_file_info(pafs.FileSelector(base)) if self.overwrite else []
        names = [f for m in messages if m is not None for f in m.files]
        for i in sorted(before, key=lambda i: MANIFEST.search(i.path) is None):  # manifests first
            if i.type == pafs.FileType.File and i.base_name not in names:
                fs.delete_file(i.path)
        with fs.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{base}/{f}")


# -- reading ----------------------------------------------------------------------------


class Source:
    """Bytes of a file with a buffer that can be peeked at and skipped over."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.buffer = file, b""

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.file.read(max(CHUNK, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.buffer = self.buffer[len(got) :]
        return got

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""


class Inflated:
    """The content of one gzip member, decoded as far as it is asked for."""

    def __init__(self, source: Source):
        self.source, self.zip, self.buffer, self.used = source, zlib.decompressobj(31), b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and not self.zip.eof:
            data = self.zip.unconsumed_tail or self.source.take(CHUNK)
            if not data:
                raise ValueError("a gzip member ends early")
            self.buffer += self.zip.decompress(data, max(CHUNK, n - len(self.buffer)))
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.buffer = self.buffer[len(got) :]
        return got

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.take(min(n, CHUNK)))):
            n -= got

    def end(self) -> None:
        """Leave the source at the member's end."""
        while not self.zip.eof:
            self.buffer = b""
            self.peek(CHUNK)
        self.source.buffer = self.zip.unused_data + self.source.buffer


def header_lines(data: Source | Inflated) -> dict[str, str] | None:
    """The version line and named fields up to the empty line; None at the end of the data."""
    while data.peek(2) == b"\r\n":
        data.skip(2)
    n = 4096
    while (at := (seen := data.peek(n)).find(b"\r\n\r\n")) < 0:
        if len(seen) < n:
            if seen.strip():
                raise ValueError("a record's header ends early")
            return None
        n *= 2
    data.skip(at + 4)
    lines = re.sub(r"\r\n[ \t]+", " ", seen[:at].decode("utf-8", "replace")).split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def bare(value: str | None) -> str | None:
    return value if value is None else value.removeprefix("<").removesuffix(">")


def columns(h: dict[str, str]) -> dict:
    """The header columns of a record."""
    low = {k.lower(): v for k, v in h.items()}
    digest, uri = low.get("warc-payload-digest"), low.get("warc-target-uri")
    return {
        "record_id": bare(low.get("warc-record-id")), "record_type": low.get("warc-type"), "target_uri": unquote(uri) if uri and ENCODED.lower() in low else uri,
        "warc_date": low.get("warc-date"), "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
        "refers_to": bare(low.get("warc-refers-to")), "payload_length": None, "content_length": int(low.get("content-length", 0)), "headers": h, "payload": None,
    }


def http_payload(row: dict, data: Source | Inflated, payloads: bool, verify: bool) -> None:
    """Fill payload_length and payload from the record's block."""
    left = row["content_length"]
    kind = next((v for k, v in row["headers"].items() if k.lower() == "content-type"), "")
    if "application/http" in kind.lower() and (at := data.peek(min(left, CHUNK)).find(b"\r\n\r\n")) >= 0:
        head = data.take(at + 4)
        left -= len(head)
        if row["record_type"] == "revisit" and (m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)):
            row["payload_length"] = int(m[1])
    if row["record_type"] == "revisit" or not (payloads or verify):
        if row["payload_length"] is None:
            row["payload_length"] = left
        data.skip(left)
        return
    body = data.take(left)
    if verify and row["payload_digest"] and len(row["payload_digest"]) == 32 and digest32(body) != row["payload_digest"]:
        raise ValueError(f"the payload of {row['record_id']} does not have its digest")
    row |= {"payload_length": len(body), "payload": body if payloads else None}


def read_file(file: pa.NativeFile, wanted: Callable[[dict], bool], payloads: bool = True, verify: bool = True) -> Iterator[dict]:
    """The wanted records of an archive."""
    source = Source(file)
    while head := source.peek(24):
        if head[:3] == b"\x1f\x8b\x08":
            size = struct.unpack("<I", head[16:20])[0] if head[3] & 4 and head[12:14] == b"sl" else 0
            start = source.file.tell() - len(source.buffer)
            data: Source | Inflated = Inflated(source)
        else:
            size, data = 0, source
        headers = header_lines(data)
        if headers is not None:
            row = columns(headers)
            if wanted(row):
                http_payload(row, data, payloads, verify)
                yield row
            elif size:  # the rest of the member stays compressed
                source.buffer = b""
                source.file.seek(start + size)
                continue
            elif isinstance(data, Source):
                data.skip(row["content_length"])
        elif data is source:
            return
        if isinstance(data, Inflated):
            data.end()


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


#: Columns that a pushed predicate can use: those known before the payload is.
HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to", "content_length"}
TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v, ds.In: lambda x, v: x in v, ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and type(f) is ds.IsNotNull:
                self.pushed.append((name, ds.IsNotNull, None))
            elif name in HEADER_COLUMNS and type(f) in TESTS:
                self.pushed.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, base = filesystem(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            infos = [fs.get_file_info(base)]
        else:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
            names: list[str] | None = None
            for m in (i for i in found if MANIFEST.search(i.path)):
                with fs.open_input_stream(m.path) as f:
                    names = (names or []) + [f"{m.path.rpartition('/')[0]}/{n}" for n in json.loads(f.read())]
            listed = None if names is None else set(names)
            infos = sorted((i for i in found if re.search(r"\.warc(\.gz)?$", i.path) and (listed is None or i.path in listed)), key=lambda i: i.path)
        groups, room = [], 0
        for i in infos:
            if not groups or room < i.size:
                groups.append(Files([]))
                room = self.partition_bytes
            groups[-1].paths.append(i.path)
            room -= i.size
        return groups

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (kind is ds.IsNotNull or TESTS[kind](row[c], v)) for c, kind, v in self.pushed)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        schema = pa.schema([
            *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to")],
            ("payload_length", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
        ])
        rows, size = [], 0
        for path in partition.paths if partition is not None else []:
            with fs.open_input_file(path) as file:
                for row in read_file(file, self.wanted, self.payloads, self.verify):
                    rows.append(row | {"headers": list(row["headers"].items())})
                    size += 1000 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(ds.DataSource):
    """Options: path, payloads (false leaves them null), verify (recompute digests), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ------------------------------------------------------------------------------

PAGE = "urn:page:"


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of `pages` (page_id, url, html), after those the path already holds.

    A null html is an empty payload, a null url no header. Of equal payloads of at least
    min_bytes the row with the largest page_id is the response (all of them if that id is
    repeated, or if every id of the group is null) and the others are revisits of it; smaller
    ones are all responses. Other columns are ignored. A payload that very many pages share is
    not shuffled; the others are shuffled once. A page of any size is one record, held whole.
    """
    register(pages.sparkSession)
    short_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("times"))
    rows = join_hot(rows, stage(largest, "largest"), ["digest"], "times")
    again = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    name = lambda c: F.concat(F.lit(PAGE), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = rows.select(
        name("page_id").alias("record_id"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, name("response_id")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, F.unhex("digest")).alias("payload_sha1"),
        F.octet_length("payload").cast("long").alias("payload_length"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from archives in the shared folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive_pages(pages, path, min_bytes)
    records = spark.read.format("warc").option("path", path).option("payloads", "false").option("verify", "true").load()
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) AS BIGINT)")
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
