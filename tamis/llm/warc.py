"""WARC archives of gzip members: a committed writer and a splittable reader.

Writing: every record is one gzip member, and a file is a run of members, written by Spark's own text sink under its
commit protocol, to any file system it knows. The sink ends each value with a separator; a member ends with the highest
byte of its length, which is zero under 16 MB (larger records are followed by an empty member), so that zero is the
separator and the file holds the members and nothing else.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, takes a position for a member's
start only if the member inflates to a record header, and owns the records that start in its range, whose last one it
reads beyond the range's end. Magic bytes inside compressed data fail that test, so no index is needed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import cut, join_table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Bytes of an archive that a task scans, and that it reads at once.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20
LEVEL = 4
#: Repeated digests (about 100 bytes each in memory) up to which their table is broadcast; of more, only the frequent ones are.
BROADCAST_DIGESTS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, uri string, refers_to string, digest string, payload_bytes long, payload binary, file string, offset long"


def sha1_base32(data: Column) -> Column:
    """SHA-1 as 32 upper-case base-32 characters, by five bytes at a time."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_bytes(record_id: str, kind: str, uri: str, digest: str, payload_bytes: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record. A revisit has no block; its payload's length is kept in an extension field."""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {clean(record_id)}", f"WARC-Target-URI: {clean(uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {clean(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Payload-Length: {payload_bytes}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = gzip_member(b"")


def write(records: DataFrame, path: str) -> None:
    """Writes ``record_id, type, uri, digest, payload_bytes, refers_to, payload`` as archive files under ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "type", "uri", "digest", "payload_bytes", "refers_to", "payload")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in names)):
                    member = gzip_member(record_bytes(*row[:6], row[6] or b""))
                    out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = records.select("record_id", "type", "uri", "digest", "payload_bytes", "refers_to", "payload").mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Source:
    """A file's bytes by position, read ahead in pieces."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from a position on."""
        if at < self.at or at + n > self.at + len(self.data):
            want = max(n, READ_BYTES)
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(want, self.size - at)) if at < self.size else b""
        lo = at - self.at
        return self.data[lo : lo + n]


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record header and where its block starts; None if this is none."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _member(source: _Source, at: int) -> tuple[dict[str, str] | None, bytes, int] | None:
    """The record in the gzip member at a position (None: an empty member), its block, and the member's end; None if there is no member."""
    z, out, pos, head, seen = zlib.decompressobj(31), bytearray(), at, None, 0
    step = 4096  # a candidate is judged by its first bytes
    while not z.eof:
        raw = source.get(pos, step)
        if not raw:
            return None
        try:
            out += z.decompress(raw)
        except zlib.error:
            return None
        pos += len(raw)
        step = READ_BYTES if head else 4096
        if head is None and out:
            if not out.startswith(b"WARC/1."[: len(out)]):
                return None
            stop = out.find(b"\r\n\r\n", max(0, seen - 3))  # a header may be of any length
            seen = len(out)
            if stop >= 0 and (head := _header(bytes(out[: stop + 4]))) is None:
                return None
    end = pos - len(z.unused_data)
    if not out:
        return None, b"", end
    if head is None:
        return None
    fields, start = head
    length = int(fields["content-length"])
    if len(out) < start + length:
        return None
    return fields, bytes(out[start : start + length]), end


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of the members that start in ``[start, end)``: offset, header fields, block."""
    source, at = _Source(file, size), start
    while at < min(end, size):
        data = source.get(at, min(READ_BYTES, size - at))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        got = _member(source, at)
        if got is None:
            at += 1
            continue
        if got[0] is not None:
            yield at, got[0], got[1]
        at = got[2]


def read(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives under ``path``: the columns of ``RECORD``.

    Files that are empty, or hold bytes that are no record, give no rows for those. ``payload`` is a record's block;
    ``payload_bytes`` the length of the payload it stands for, also where a revisit holds no block.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inner = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    rows, held = [], 0
                    for at, f, block in scan_range(file, length, start, start + split_bytes):
                        size = int(f.get("x-payload-length", len(block)))
                        digest = f.get("warc-payload-digest")
                        rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), digest and digest.removeprefix("sha1:"), size, block, path, at))
                        held += len(block) + len(f.get("warc-target-uri", ""))
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ranges.mapInArrow(scan, RECORD)


def archive(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of ``page_id, url, html``; of equal payloads the one with the largest id is the response.

    Null html is an empty payload. The others of its kind are revisits that refer to it. Payloads are compared by SHA-1
    over their UTF-8 bytes. Only ids and digests are shuffled to find the payloads that occur more than once. Up to
    BROADCAST_DIGESTS of those are broadcast. Of more, the frequent ones are; then ids are joined with the rest by
    digest, narrow rows without html, and pages with what was found by id, so no digest gathers its pages in one task.
    Rows that repeat the winning id are all responses; null ids lose to any id, and are responses where there is no
    other. Other columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digest = sha1_base32(payload).alias("digest")
    several = cut(pages.select("page_id", digest).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1"))
    repeated, rows = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    d = pages.select("page_id", F.coalesce("url", F.lit("")).alias("uri"), payload.alias("payload")).withColumn("digest", sha1_base32(F.col("payload")))
    if repeated <= BROADCAST_DIGESTS:
        d = d.join(F.broadcast(several.drop("n")), "digest", "left")
    else:
        # pages whose id is not the best of its digest, by id and digest: an id may be on several rows
        lost = join_table(pages.select("page_id", digest), several, "digest", "n", rows)
        lost = lost.where("page_id is null or page_id <> best").select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("_id"), "digest", "best").distinct()
        d = d.withColumn("_id", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).join(cut(lost), ["_id", "digest"], "left")
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    own = F.coalesce("best", "page_id").eqNullSafe(F.col("page_id"))
    write(
        d.select(
            name(F.col("page_id")).alias("record_id"), F.when(own, "response").otherwise("revisit").alias("type"), "uri", "digest",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~own, name(F.col("best"))).alias("refers_to"), F.when(own, F.col("payload")).alias("payload"),
        ),
        path,
    )


def page_id(name: Column) -> Column:
    """The page's id in a record id."""
    return F.nullif(F.regexp_extract(name, "^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")


def fresh_path(folder: str) -> str:
    return f"{folder}/warc-{uuid.uuid4().hex}"
