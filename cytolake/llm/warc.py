"""WARC archives: a writer that stores equal payloads once, and a reader that splits archives.

Every record is a gzip member of its own. The writer groups equal payloads by digest; the row with the largest id of a group
becomes a ``response`` with the payload, the others ``revisit`` records that name it. Archives are written where the tasks
run, under names no other attempt uses; an archive counts once the manifest lists it, so the rest of a lost or
repeated attempt is never read.

The reader cuts archives into byte ranges. A task searches its range for the magic bytes of a gzip member, takes a candidate for
real if it decodes to the head of a WARC record, reads that record to its end, also beyond the range, and goes on behind it.
A record belongs to the range in which it starts, so none is read twice and none is lost. Bytes inside a record can look
like a record (a page that is an archive itself): what lies within another record of the archive is dropped at the end.

Files are opened through ``pyarrow.fs``: local and shared folders, ``s3://``, ``gs://`` and, with the client library, ``hdfs://``.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.llm.joins import broadcast_if_few
from cytolake.llm.workers import tidy
from cytolake.runtime import cut

# Fixed values of the formats: start of a gzip member (RFC 1952) and the names of a WARC 1.1 record.
GZIP_MAGIC = b"\x1f\x8b\x08"
RESERVED_FLAGS = 0xE0
VERSION = b"WARC/1.1"
ANY_VERSION = b"WARC/"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
#: both ends of a gzip stream with header and checksum, for zlib
GZIP_BITS = 31
#: bytes read at a time
CHUNK = 1 << 18

MANIFEST = "path string, bytes bigint, records bigint"
RECORD = (
    "path string, offset bigint, bytes bigint, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, intact boolean, payload binary"
)
_RECORD_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("intact", pa.bool_()), ("payload", pa.binary()),
])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path within."""
    path = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", path))
    return fs.FileSystem.from_uri(path)


def bare_digest(sha1: bytes) -> str:
    """Upper-case base32, as archives write SHA-1 digests."""
    return base64.b32encode(sha1).decode()


def record_id(row_id: str | None, digest: str) -> str:
    """URI of the record of a row; rows of equal id and payload share it."""
    return f"<urn:no-row:{digest}>" if row_id is None else f"<urn:row:{quote(row_id, safe='')}:{digest}>"


def row_of(uri: str | None) -> str | None:
    """The row id in a URI of :func:`record_id`."""
    found = re.fullmatch(r"<urn:row:([^:]*):[A-Z2-7]*>", uri or "")
    return unquote(found[1]) if found else None


def _member(fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), f"Content-Length: {len(block)}".encode()]
    press = zlib.compressobj(level, zlib.DEFLATED, GZIP_BITS)
    return b"".join([press.compress(b"\r\n".join(lines) + b"\r\n\r\n"), press.compress(block), press.compress(b"\r\n\r\n"), press.flush()])


def _uri(url: str | None) -> str | None:
    """A URL on one line: what no header may hold is percent-encoded."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\\\"<>")


def record(row_id: str | None, url: str | None, payload: bytes, date: str, first: str | None = None, first_url: str | None = None, revisits: bool = False, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit of the record of row ``first``."""
    digest = bare_digest(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(row_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisits:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", _uri(first_url))]
    return _member([*fields, ("Content-Type", HTTP_TYPE)], http if revisits else http + payload, level)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = 1 << 28,
    date: str = "2000-01-01T00:00:00Z",
    level: int = 6,
) -> None:
    """Archives of about ``archive_bytes`` below ``folder``, listed in ``folder/manifest`` (Parquet).

    Payloads of at least ``least_bytes`` bytes are stored once: the row with the largest id of equal ones is a response, the others
    revisit it. Rows that repeat this largest id are responses all; ids that are null are the smallest, and a group
    with no other id has responses only. Null payloads count as empty; a null URL leaves its field out; control characters
    of URLs are percent-encoded. An empty table gives a manifest without rows. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("content", F.unhex(F.sha2("payload", 256)))
    many = rows.where(F.octet_length("payload") >= least_bytes).groupBy("content").agg(
        F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = cut(many.where("n > 1 and first.id is not null").select("content", "first"))
    told = rows.join(broadcast_if_few(firsts), "content", "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", F.col("first.id").cast("string").alias("first"), F.col("first.url").alias("first_url"),
        F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")), F.lit(False)).alias("revisits"),
    )
    info = _member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        out = None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("id", "url", "payload", "first", "first_url", "revisits")]):
                row_id, url, data, first, first_url, revisits = (x.as_py() for x in row)
                if out is None:
                    name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{base}/{name}", compression=None), len(info), 0
                    out.write(info)
                member = record(row_id, url, data, date, first, first_url, revisits, level)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    told.mapInArrow(tidy(archives), MANIFEST).write.mode("errorifexists").parquet(f"{folder}/manifest")


def candidate(file, start: int, end: int) -> int | None:
    """Place of the next magic bytes that begin in ``[start, end)``."""
    while start < end:
        file.seek(start)
        data = file.read(min(CHUNK, end - start) + len(GZIP_MAGIC))  # with the flags behind the magic bytes
        at = data.find(GZIP_MAGIC)
        if at < 0:
            start += max(1, len(data) - len(GZIP_MAGIC))
            if len(data) <= len(GZIP_MAGIC):
                return None
        elif start + at >= end:
            return None
        elif at + 3 < len(data) and not data[at + 3] & RESERVED_FLAGS:
            return start + at
        else:
            start += at + 1
    return None


class NotARecord(Exception):
    """The bytes are no gzip member that begins with the head of a record."""


def _unpacked(file, offset: int, ended: list[int]) -> Iterator[bytes]:
    """The member's bytes in chunks; then its length goes to ``ended``."""
    unpress, fed = zlib.decompressobj(GZIP_BITS), 0
    file.seek(offset)
    while not unpress.eof:
        data = unpress.unconsumed_tail
        if not data:
            data = file.read(CHUNK)
            fed += len(data)
            if not data:
                raise zlib.error("the member has no end")
        yield unpress.decompress(data, 4 * CHUNK)
    ended.append(fed - len(unpress.unused_data))


def _until_blank(chunks: Iterator[bytes], held: bytes, prefix: bytes, left: int | None = None) -> tuple[bytes, bytes]:
    """Bytes before and behind the first blank line, reading on as needed; no more than ``left`` bytes are looked at."""
    seen = 0
    while True:
        at = held.find(b"\r\n\r\n", max(0, seen - 3))
        if at >= 0:
            return held[:at], held[at + 4 :]
        if not prefix.startswith(held[: len(prefix)]) or left is not None and len(held) >= left:
            raise NotARecord
        seen, more = len(held), next(chunks, None)
        if more is None:
            raise NotARecord
        held += more


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_record(file, offset: int, with_payload: bool) -> dict:
    """The record whose member starts at ``offset``; ``intact`` if it decodes to its end and its payload has its digest.

    Digest and size are those of the payload read, or, for a revisit, those its head and its HTTP head state.
    """
    ended: list[int] = []
    chunks = _unpacked(file, offset, ended)
    try:
        head, rest = _until_blank(chunks, next(chunks, b""), ANY_VERSION)
        fields = _fields(head)
        if not head.startswith(ANY_VERSION) or "warc-type" not in fields or not fields.get("content-length", "").isdigit():
            raise NotARecord
    except zlib.error as e:
        raise NotARecord from e
    size = int(fields["content-length"])
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {
        "offset": offset, "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": stated, "payload_bytes": None, "payload": None,
    }
    digest, count, kept, http = hashlib.sha1(), 0, [], {}
    try:
        if fields.get("content-type", "").startswith("application/http"):
            http_head, rest = _until_blank(chunks, rest, b"HTTP/", size)
            http = _fields(http_head)
            size -= len(http_head) + 4
        while True:  # the payload, then two line ends
            data = rest[: max(0, size - count)]
            count += len(data)
            digest.update(data)
            if with_payload:
                kept.append(data)
            rest = next(chunks, None)
            if rest is None:
                break
    except (zlib.error, NotARecord):
        return out | {"bytes": 1, "intact": False}
    if out["record_type"] == "revisit":
        length = http.get("content-length", "")
        return out | {"bytes": ended[0], "payload_bytes": int(length) if length.isdigit() else None, "intact": count == size}
    found = bare_digest(digest.digest())
    out |= {"bytes": ended[0], "payload_digest": found, "payload_bytes": count, "intact": count == size and stated in (None, found)}
    return out | {"payload": b"".join(kept)} if with_payload else out


def records_in(file, start: int, end: int, with_payload: bool = False) -> Iterator[dict]:
    """Records whose members start in ``[start, end)``."""
    at = candidate(file, start, end)
    while at is not None:
        try:
            found = read_record(file, at, with_payload)
        except NotARecord:
            at = candidate(file, at + 1, end)
            continue
        yield found
        at = candidate(file, at + found["bytes"], end)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes)`` of the archives of a folder: those its manifest lists, or all ``*.warc.gz`` below it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz")
    return listed.load(folder).select("path", F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, range_bytes: int = 1 << 24, with_payload: bool = False) -> DataFrame:
    """A row per record of the ``(path, bytes)`` ``archives``; columns as in ``RECORD``.

    A record whose bytes are damaged is there with ``intact`` false. Null, empty and missing parts are null. Payloads are
    left out unless asked for. No archive gives no row.
    """
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / range_bytes)))
    ranges = archives.where("bytes > 0").select("path", "bytes", at.alias("k"))
    tasks = max(1, ranges.count())
    kept = _RECORD_ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, k in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "k")]):
                store, local = store_of(path)
                with store.open_input_file(local) as file:
                    rows, held = [], 0
                    for found in records_in(file, k * range_bytes, min(size, (k + 1) * range_bytes), with_payload):
                        rows.append(found | {"path": path})
                        held += len(found["payload"] or b"")
                        if len(rows) >= 1000 or held >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=kept)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kept)

    found = ranges.repartition(tasks).mapInArrow(tidy(run), RECORD)
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)  # the records of one archive
    outside = found.withColumn("_reach", F.max(F.col("offset") + F.col("bytes")).over(before))
    return outside.where("_reach is null or offset >= _reach").drop("_reach")
