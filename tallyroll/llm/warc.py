"""WARC archives: written as gzip members by Spark's own writer, read by a splittable scan.

Writing: a partition's records become members, and runs of members become rows of Spark's text writer, whose
commit protocol deals with lost and repeated tasks. Its line separator is an empty gzip member, which every
gzip reader passes over. Of records with equal payloads that with the largest id is a response, the others are
revisits that name it; equality is found by a digest, with one aggregated row per digest that repeats.

Reading: files are cut into byte ranges, one row each. A task looks for the gzip magic in its range,
validates each candidate by decoding its header and first bytes, and owns the records whose member starts
inside, reading past the end for the last one. Files of any size are read in parallel.

Null payloads are empty ones; null ids give records without one, which are responses unless a record with an
id has the same payload. Ids that share the largest place are all responses. A member is held in memory
as a whole; one that is cut off or damaged gives a row with ``error``. A member whose stored bytes hold
another whole member could be read twice where a range begins inside it. An empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyroll.llm.common import slices, stored

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
BLOCK = 4_000_000
STEP = 1 << 20
FIRST = 1 << 14
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def member(record_id: int | None, uri: str | None, payload: bytes, revisits: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header of the whole response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    own = record_id if record_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {digest(payload)}")
    lines = [
        ("WARC-Type", "response" if revisits is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{own}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri or "")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Refers-To", f"<{ID_PREFIX}{revisits}>"), ("WARC-Profile", PROFILE)] if revisits is not None else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(head + block + b"\r\n\r\n") + coder.flush()


def write_archives(
    df: DataFrame, path: str, id_column: str, uri: str, payload: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write one record per row under ``path``; equal payloads from ``min_bytes`` bytes on are stored once."""
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{uri}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("_same", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    again = rows.filter("_same is not null").groupBy("_same").agg(F.max("id").alias("_last"), F.count(F.lit(1)).alias("n"))
    again = stored(again.filter("n > 1").select(F.col("_same").alias("_key"), "_last"), "again")
    older = ~F.col("id").eqNullSafe(F.col("_last"))
    rows = rows.join(again, F.col("_same") == F.col("_key"), "left").select("id", "uri", "payload", F.when(older, F.col("_last")).alias("revisits"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 2):
            for r in part.to_pylist():
                held.append(member(r["id"], r["uri"], r["payload"], r["revisits"], date))
                size += len(held[-1])
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])

    blocks = rows.mapInArrow(work, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)


class Source:
    """Bytes of a file by place, through one buffer."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.held = file, file.size(), 0, b""

    def get(self, begin: int, length: int) -> bytes:
        length = min(length, self.size - begin)
        if begin < self.base or begin + length > self.base + len(self.held):
            self.base, self.held = begin, self.file.read_at(max(length, min(STEP, self.size - begin)), begin)
        return self.held[begin - self.base : begin - self.base + length]

    def open_member(self, begin: int) -> tuple[bytes | None, int, str | None]:
        """(content, place after it, error) of the member at ``begin``; content is null if it is none of ours."""
        coder, out, at, length, known = zlib.decompressobj(31), [], begin, FIRST, False
        try:
            while not coder.eof:
                raw = self.get(at, length)
                if not raw:
                    return None, at, "cut off" if known else None
                at, length = at + len(raw), STEP
                out.append(coder.decompress(raw))
                if not known and (len(b"".join(out[:8])) >= 5 or coder.eof):
                    head = b"".join(out)
                    if head[:5] != b"WARC/" and not (coder.eof and not head):
                        return None, begin + 1, None
                    known = True
        except zlib.error as e:
            return None, begin + 1, str(e) if known else None
        return b"".join(out), at - len(coder.unused_data), None

    def members(self, begin: int, end: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
        """(place, length, content, error) of the members that start in the range."""
        at = begin
        while at < end:
            block = self.get(at, STEP)
            hit = block.find(MAGIC)
            if hit < 0:
                if len(block) < STEP:
                    return
                at += len(block) - 2
                continue
            at += hit
            if at >= end:
                return
            content, after, error = self.open_member(at)
            if content or error:
                yield at, after - at, content, error
            at = after if content is not None else at + 1


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records in a member."""
    at = 0
    while content.startswith(b"WARC/", at):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", "0"))
        yield headers, content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while content[at : at + 2] == b"\r\n":
            at += 2


def described(headers: dict[str, str], block: bytes) -> dict:
    """One result row; a response's digest is that of its payload, a revisit's the declared one."""
    http, gap, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = headers.get("warc-type")
    if kind == "revisit":
        told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
        size, sha1, payload = int(told[1]) if told else None, declared, None
    else:
        size, sha1 = len(payload), digest(payload)
    return {
        "record_type": kind,
        "record_id": headers.get("warc-record-id", "").strip("<>") or None,
        "uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
        "payload_bytes": size,
        "payload_digest": sha1,
        "intact": declared is None or declared == sha1,
        "payload": payload,
        "error": None,
    }


ROW = pa.schema(
    [
        ("file", pa.string()),
        ("place", pa.int64()),
        ("length", pa.int64()),
        *[(n, pa.string()) for n in ("record_type", "record_id", "uri", "date", "refers_to")],
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("intact", pa.bool_()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


def split_bytes(spark: SparkSession) -> int:
    """The session's size of a file split."""
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def read_archives(spark: SparkSession, path: str, payload: bool = True, split: int | None = None) -> DataFrame:
    """A row per record of all files under ``path``: ROW's columns; ``payload`` stays null if not wanted."""
    step = split or split_bytes(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("begin"))
    number = ranges.count()
    ranges = ranges.repartition(max(1, min(number, 100_000)))
    names = ROW.names
    kinds = "file string, place long, length long, record_type string, record_id string, uri string, date string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary, error string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", r["path"]))
                held, size = [], 0
                with system.open_input_file(name) as file:
                    for place, length, content, error in Source(file).members(r["begin"], r["begin"] + step):
                        found = [described(*x) for x in records(content)] if content else [dict.fromkeys(names) | {"error": error}]
                        for row in found:
                            if not payload:
                                row["payload"] = None
                            held.append(row | {"file": r["path"], "place": place, "length": length})
                            size += len(row["payload"] or b"") + 500
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(held, ROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, ROW)

    return ranges.mapInArrow(work, kinds)
