"""WARC archives as a Python data source.

Reading plans partitions over whole files, parses a record's header first and
applies the predicates pushed down to it; the rest of an unwanted record is passed
over without decoding it.  In compressed files every record is a gzip member of its own with a
``sl`` extra field (compressed and plain length), which tells where the next
one starts; members of other writers, without it, are inflated and dropped.

Writing streams records into files in the shared file system.  Files of failed attempts are never
listed: the job's commit writes a manifest, and readers take what it names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import materialize, prepare, shared_path

MANIFEST = "_manifest.json"
#: Columns that a header alone gives, with the header's name.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
    "content_length": "Content-Length",
}
NUMBERS = ("payload_length", "content_length")
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, payload_digest string, "
    "payload_length long, content_length long, payload binary, payload_sha1 string, payload_bytes long"
)
DECODED = ("payload", "payload_sha1", "payload_bytes")


# -- files, wherever they are ---------------------------------------------------------------


def file_system(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def list_archives(path: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's archives: those of its manifest, or all if it has none."""
    from pyarrow import fs

    files, folder = file_system(path)
    info = files.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [(folder, info.size)]
    found = {i.path: i.size for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.path.endswith((".warc", ".warc.gz"))}
    if files.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
        with files.open_input_stream(f"{folder}/{MANIFEST}") as stream:
            listed = [f"{folder}/{n}" for n in json.loads(stream.read())]
        missing = [n for n in listed if n not in found]
        if missing:
            raise FileNotFoundError(f"{len(missing)} archives of the manifest are missing, e.g. {missing[0]}")
        return sorted((n, found[n]) for n in listed)
    return sorted(found.items())


# -- records --------------------------------------------------------------------------------


def member(plain: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain)) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def header_bytes(headers: list[tuple[str, str | None]]) -> bytes:
    """Header block; line breaks inside values become spaces, null values are left out."""
    lines = [f"{k}: {' '.join(v.splitlines()) if v else v}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "surrogatepass")


def parse_header(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class Source:
    """Buffered bytes of a file, with a way to skip and to give back what was read too far."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def peek(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.buffer += self.file.read(max(n - len(self.buffer), 1 << 16))
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.buffer = self.buffer[len(out) :]
        return out

    def some(self, n: int) -> bytes:
        """Between one and ``n`` bytes, unless the file ends: what is there, without copying more together."""
        if not self.buffer:
            return self.file.read(n)
        return self.take(min(n, len(self.buffer)))

    def unread(self, rest: bytes) -> None:
        self.buffer = rest + self.buffer

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""


def records(file, wanted, decode: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of the records whose header is wanted; block is None unless decoded."""
    source = Source(file)
    while True:
        start = source.peek(2)
        if not start:
            return
        if start == b"\x1f\x8b":
            yield from gzip_record(source, wanted, decode)
        elif start == b"WA":
            head = plain_header(source)
            size = int(head.get("content-length", 0))
            if wanted(head):
                if decode:
                    yield head, source.take(size)
                else:
                    source.skip(size)
                    yield head, None
            else:
                source.skip(size)
        elif start in (b"\r\n", b"\n\n"):
            source.take(2)
        else:
            raise ValueError(f"no WARC record starts with {start!r}")


def plain_header(source: Source) -> dict[str, str]:
    size = 1 << 12
    while b"\r\n\r\n" not in (seen := source.peek(size)):
        if len(seen) < size:
            raise ValueError("a WARC header has no end")
        size *= 2
    return parse_header(source.take(seen.index(b"\r\n\r\n") + 4)[:-4])


def skip_length(source: Source) -> int | None:
    """Compressed length by a member's extra field ``sl``, if it has one."""
    head = source.peek(12)
    if len(head) == 12 and head[3] & 4:
        extra = source.peek(12 + struct.unpack_from("<H", head, 10)[0])[12:]
        at = 0
        while at + 4 <= len(extra):
            name, size = struct.unpack_from("<2sH", extra, at)
            if name == b"sl" and size >= 4:
                return struct.unpack_from("<I", extra, at + 4)[0]
            at += 4 + size
    return None


def gzip_record(source: Source, wanted, decode: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The record of a gzip member, inflated chunk by chunk: every byte is read and copied once."""
    length = skip_length(source)
    inflate = zlib.decompressobj(31)
    used = 0

    def more(limit: int) -> bytes:
        nonlocal used
        chunk = inflate.unconsumed_tail
        if not chunk:
            chunk = source.some(1 << 16 if length is None else min(1 << 16, length - used))
            used += len(chunk)
            if not chunk:
                raise ValueError("a gzip member has no end")
        return inflate.decompress(chunk, limit)

    plain = b""
    while b"\r\n\r\n" not in plain and not inflate.eof:
        plain += more(1 << 11)
    raw, _, block = plain.partition(b"\r\n\r\n")
    head = parse_header(raw)
    take = wanted(head)
    parts = [block]
    if take and decode or length is None:
        while not inflate.eof:
            part = more(1 << 20)
            if take and decode:
                parts.append(part)
    if length is None:
        source.unread(inflate.unused_data)
    else:
        source.skip(length - used)
    if take:
        yield head, b"".join(parts)[: int(head.get("content-length", 0))] if decode else None


def column(head: dict[str, str], name: str):
    value = head.get(HEADERS[name].lower())
    if name in NUMBERS:
        return int(value) if value is not None and value.isdigit() else None
    return value


# -- predicates -----------------------------------------------------------------------------


TESTS = {
    "=": ds.EqualTo,
    "in": ds.In,
    ">": ds.GreaterThan,
    ">=": ds.GreaterThanOrEqual,
    "<": ds.LessThan,
    "<=": ds.LessThanOrEqual,
    "starts with": ds.StringStartsWith,
    "ends with": ds.StringEndsWith,
    "contains": ds.StringContains,
    "is null": lambda column, _: ds.IsNull(column),
    "is not null": lambda column, _: ds.IsNotNull(column),
}


def predicate(name: str, test: str, value=None):
    """A filter on a header's column; a test may begin with ``not``."""
    if name not in HEADERS:
        raise ValueError(f"{name} is no column of headers")
    if test.startswith("not "):
        return ds.Not(predicate(name, test[4:], value))
    return TESTS[test]((name,), value)


def supported(f) -> bool:
    if isinstance(f, ds.Not):
        return supported(f.child)
    kinds = (ds.EqualTo, ds.In, ds.IsNull, ds.IsNotNull, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    return isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


def holds(f, head: dict[str, str]) -> bool | None:
    """Three-valued truth of a predicate on a header."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, head)
        return None if inner is None else not inner
    value = column(head, f.attribute[0])
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if value is None:
        return None
    tests = {
        ds.EqualTo: lambda: value == f.value,
        ds.In: lambda: value in f.value,
        ds.GreaterThan: lambda: value > f.value,
        ds.GreaterThanOrEqual: lambda: value >= f.value,
        ds.LessThan: lambda: value < f.value,
        ds.LessThanOrEqual: lambda: value <= f.value,
        ds.StringStartsWith: lambda: value.startswith(f.value),
        ds.StringEndsWith: lambda: value.endswith(f.value),
        ds.StringContains: lambda: f.value in value,
    }
    return tests[type(f)]()


# -- the data source ------------------------------------------------------------------------


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path = schema.fieldNames(), options["path"]
        self.schema, self.pack = schema, int(options.get("partition_bytes", 16 << 20))
        self.filters = [predicate(*one) for one in json.loads(options.get("where", "[]"))]

    def partitions(self):
        out, now, size = [], [], 0
        for path, n in list_archives(self.path):
            if now and size + n > self.pack:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n
        return [*out, Files(tuple(now))] if now else [Files(())]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        files, _ = file_system(self.path)
        decode = any(n in DECODED for n in self.names)
        wanted = lambda head: all(holds(f, head) for f in self.filters)
        rows: list[list] = [[] for _ in self.names]
        size = 0
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for head, block in records(file, wanted, decode):
                    payload = payload_of(head, block) if decode else None
                    for out, name in zip(rows, self.names, strict=True):
                        out.append(column(head, name) if name in HEADERS else decoded(name, payload))
                    size += 1000 + (len(payload) if payload is not None and "payload" in self.names else 0)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, schema.types, strict=True)], schema=schema)
                        rows, size = [[] for _ in self.names], 0
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, schema.types, strict=True)], schema=schema)


class PushingReader(WarcReader):
    """A reader that also takes the filters of Spark's own optimiser, for sessions that turn that on.

    Spark 4.1 keeps a relation's pushed filters for later scans of the same
    DataFrame, so every query needs a DataFrame of its own; the option
    ``where`` has no such trap.
    """

    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f


def payload_of(head: dict[str, str], block: bytes | None) -> bytes | None:
    """The HTTP body of a response; the block of other kinds; None for a revisit."""
    if block is None or head.get("warc-type") == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def decoded(name: str, payload: bytes | None):
    if payload is None or name == "payload":
        return payload
    return hashlib.sha1(payload).hexdigest() if name == "payload_sha1" else len(payload)


@dataclass
class Written(ds.WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows need record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload.

    A ``date`` is the record's; without one it is the time of writing.
    """

    def __init__(self, options):
        self.path, self.roll = options["path"], int(options.get("file_bytes", 64 << 20))

    def write(self, iterator):
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = files.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    out.write(member(record(row)))
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names))

    def commit(self, messages):
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps(sorted(n for m in messages if m is not None for n in m.names)).encode())
        files.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages):
        files, folder = file_system(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                files.delete_file(f"{folder}/{n}")


def record(row: dict) -> bytes:
    payload = row["payload"] if row["payload"] is not None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(row["payload_length"]).encode() + b"\r\n\r\n"
    block = http if row["record_type"] == "revisit" else http + payload
    head = [(HEADERS[c], row[c]) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
    head.insert(2, ("WARC-Date", row.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")))
    head += [("WARC-Payload-Length", str(row["payload_length"])), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if row["record_type"] == "revisit":
        head.insert(2, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return header_bytes(head) + block + b"\r\n\r\n"


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushing else WarcReader)(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[tuple] = ()) -> DataFrame:
    """Records under a path; with columns of headers alone no block is decoded.

    ``where`` lists predicates on header columns, (column, test, value) with a
    test of ``TESTS``, which readers apply to parsed headers before anything else.
    """
    register(spark)
    for one in where:
        predicate(*one)
    kinds = dict(f.split() for f in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("where", json.dumps(list(where))).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date_col: str | None = None) -> DataFrame:
    """One record per page for the writer: equal payloads of ``least_bytes`` and more become revisits.

    Repeated payloads are found by digest and length alone and written; payloads
    then move only if that table is too large to broadcast by Spark's own check.
    Records have the time of writing as their date, or that of a ``date_col``.

    The page with the largest id is the response that they refer to.  A null
    payload counts as empty; a null URL leaves its header out; a null id gives a
    record without a number, always a response; repeated rows of the largest id are responses all.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "utf-8")
    date = F.date_format(F.to_utc_timestamp(F.col(f"`{date_col}`"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload"), date.alias("date"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    repeated = rows.where(F.col("payload_length") >= least_bytes).groupBy("digest", "payload_length").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "payload_length", "first")
    rows = rows.join(materialize(repeated, "repeated"), ["digest", "payload_length"], "left")
    revisit = F.col("id").isNotNull() & F.col("first").isNotNull() & (F.col("id") != F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        name(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "date",
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_path(spark, "warc")
    page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    headers = ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # Revisits are read by their headers alone; only responses are decoded.
    revisits = read_warc(spark, path, headers, [("record_type", "=", "revisit")]).select("*", F.col("payload_length").alias("n"), F.substring("payload_digest", 6, 40).alias("sha1"))
    others = read_warc(spark, path, [*headers, "payload_sha1", "payload_bytes"], [("record_type", "not =", "revisit")]).select(*headers, F.col("payload_bytes").alias("n"), F.col("payload_sha1").alias("sha1"))
    read = revisits.unionByName(others)
    return read.select(number("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  r AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest
"""
