"""WARC archives of gzip members: writer and splittable reader.

Writer: every record is one gzip member.  Members are rows of a text write whose line
separator is one zero byte: the last byte of a member is the top byte of its uncompressed
length and zero below 16 MiB, so the row holds the member without it and the separator puts it
back (a longer record is followed by an empty member, which ends in zero).  Spark's own commit
protocol thus holds for the archives, on any store Spark writes to.

Reader: files are listed by Spark and cut into byte ranges, one task row each.  A task scans its
range for the gzip magic, validates every candidate by decoding it until the record's headers
are complete, and owns the records whose member starts inside its range, reading on past the end
of the range to finish the last one.  A candidate that does not decode to record headers, however
long, is skipped; after a record the scan goes on behind its member.

Defined results: a null payload is written as an empty one, a null uri or id as no such header;
line breaks and other control characters in header values are percent-encoded.  Equal payloads
below ``min_bytes`` stay full records.  Of equal longer payloads all rows that carry the smallest
id are responses (repeated rows included), the others refer to it; an id that is null never is
the smallest unless all are.  An empty table gives an archive without records.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
RECORDS = ("record_type string, id long, uri string, digest string, refers_to long, payload_length long, "
           "payload binary")


def mark_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 100) -> DataFrame:
    """Adds digest, payload_length, record_type and refers_to to a table with a binary payload.

    Only (digest, smallest key) of payloads that occur twice are joined back, so a payload held by
    a third of all rows is reduced before the shuffle and its rows can be split among tasks.
    """
    rows = pages.withColumns({"digest": F.sha2(payload, 256), "payload_length": F.octet_length(payload).cast("long")})
    first = (rows.where(F.col("payload_length") >= min_bytes).groupBy("digest")
             .agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    later = F.col("first_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_id"))
    return (rows.join(first, "digest", "left")
            .withColumns({"record_type": F.when(later, "revisit").otherwise("response"),
                          "refers_to": F.when(later, F.col("first_id"))}).drop("first_id"))


def _clean(value) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _member(kind, key, uri, digest, refers, length, payload: bytes) -> bytes:
    block = _HTTP + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Record-ID: <urn:x-row:{key}>"] if key is not None else []
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-row:{refers}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress("\r\n".join(lines).encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY


def write(records: DataFrame, path: str) -> None:
    """Write (record_type, id, uri, digest, refers_to, payload_length, payload) as archives below ``path``."""
    def members(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for lo in range(0, batch.num_rows, 200):
                rows = zip(*(c.slice(lo, 200).to_pylist() for c in columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_member(*r)[:-1] for r in rows], pa.binary())], ["member"])

    df = records.select("record_type", "id", "uri", "digest", "refers_to", "payload_length",
                        F.coalesce("payload", F.lit(b"")).alias("payload"))
    (df.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\u0000").text(path))


class _Bytes:
    """A window over an open file that grows on demand and forgets what lies behind it."""

    def __init__(self, source, at: int, step: int = 1 << 18):
        self.source, self.step, self.base, self.held, self.ended = source, step, at, b"", False
        source.seek(at)

    def upto(self, end: int) -> None:
        while self.base + len(self.held) < end:
            more = self.source.read(max(self.step, end - self.base - len(self.held)))
            if not more:
                self.ended = True
                return
            self.held += more

    def forget(self, before: int) -> None:
        if before - self.base > self.step:
            self.held, self.base = self.held[before - self.base:], before


def _decode(window: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and the end of its member, or None if none starts there."""
    unpack, head, parts, pos, proven = zlib.decompressobj(31), bytearray(), [], at, False
    while not unpack.eof:
        window.upto(pos + 65536)
        chunk = window.held[pos - window.base:pos - window.base + 65536]
        if not chunk:
            return None
        try:
            data = unpack.decompress(chunk)
        except zlib.error:
            return None
        pos += len(chunk)
        if not proven:
            seen = len(head)
            head += data
            if head[:7] != b"WARC/1."[:len(head)]:
                return None
            proven = head.find(b"\r\n\r\n", max(0, seen - 3)) >= 0
            if not proven and unpack.eof:
                return None
        else:
            parts.append(data)
            window.forget(pos)
    return b"".join([head, *parts]), pos - len(unpack.unused_data)


def _row_id(headers: dict, name: str) -> int | None:
    found = re.fullmatch(r"<urn:x-row:(-?\d+)>", headers.get(name, ""))
    return int(found[1]) if found else None


def _parse(record: bytes) -> tuple | None:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not headers.get("Content-Length", "").isdigit():
        return None
    payload = rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]
    length = headers.get("X-Payload-Length", "")
    return (headers.get("WARC-Type"), _row_id(headers, "WARC-Record-ID"), headers.get("WARC-Target-URI"),
            headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, _row_id(headers, "WARC-Refers-To"),
            int(length) if length.isdigit() else None, payload)


def scan(source, start: int, end: int):
    """The records whose member starts in [start, end) of an open file."""
    window, at = _Bytes(source, start), start
    while at < end:
        window.upto(at + window.step)
        found = window.held.find(MAGIC, at - window.base)
        if found < 0:
            if window.ended:
                return
            at = window.base + len(window.held) - len(MAGIC) + 1
            window.forget(at)
            continue
        at = window.base + found
        if at >= end:
            return
        window.forget(at)
        record = _decode(window, at)
        row = _parse(record[0]) if record else None
        if row:
            yield row
            at = record[1]
        else:
            at += 1


def read(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of all archives below ``path``, read by byte ranges of ``split_bytes``."""
    schema = pa.schema([("record_type", pa.string()), ("id", pa.int64()), ("uri", pa.string()),
                        ("digest", pa.string()), ("refers_to", pa.int64()), ("payload_length", pa.int64()),
                        ("payload", pa.binary())])

    def records(batches):
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
                with store.open_input_file(name) as source:
                    held, size = [], 0
                    for row in scan(source, start, end):
                        held.append(row)
                        size += len(row[-1])
                        if size > 4 << 20 or len(held) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = (files.where("length > 0").select("path", "length", start.alias("start"))
              .select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(records, RECORDS)
