"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writing.  Every capture becomes one record in a gzip member of its own.  Of captures with equal
payloads the one with the largest id is the response, the others are revisits that refer to it and
keep the HTTP headers only (their Content-Length still tells the payload's length).  Spark's text
writer writes the files, so they reach any store Spark reaches and survive lost executors; it puts
a separator after each row, and since a member of under 16 MiB ends in a zero byte, that byte is
the separator (a longer one is followed by an empty member, which ends in a zero byte too).

Reading.  A member or version line is taken when all its checks pass: gzip checksum, headers,
length, block digest and payload digest.  After a failed check the reader searches for the next
member or version line that passes, goes on from there, and logs the bytes between as a gap.  In a
member it does the same with the inflated bytes, those before a damaged place included: records that
pass are kept, and a gap between them has the member's place and the number of its bytes inside.

Defined cases: a null payload is empty; a null url gets a urn; rows equal in id and payload are one
capture, each written as a response; a null id revisits, or responds when no other id has its
payload; an empty table writes no record; columns
other than id, url and payload are ignored.  A file is read by one task: the writer bounds its records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 2000
#: Of two records of equal payloads of at least so many bytes, one is a revisit.
MIN_REVISIT_BYTES = 0
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_STEP = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def build_record(page_id, url, payload: bytes, refers_to, is_response: bool, date: str) -> bytes:
    """One record as plain bytes, without the blank lines that end it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id)[1:-1]
    lines = [
        "WARC-Type: " + ("response" if is_response else "revisit"),
        "WARC-Record-ID: " + record_id(page_id),
        "WARC-Date: " + date,
        "WARC-Target-URI: " + uri,
        "WARC-Payload-Digest: sha1:" + sha1_base32(payload),
        "WARC-Block-Digest: sha1:" + sha1_base32(block),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not is_response:
        lines += ["WARC-Profile: " + PROFILE, "WARC-Refers-To: " + record_id(refers_to)]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def member(record: bytes, level: int = 6) -> bytes:
    """The record, ended by blank lines, as a gzip member that ends in a zero byte."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(record + b"\r\n\r\n") + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


# ---- writing ---------------------------------------------------------------------------


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = RECORDS_PER_FILE,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write pages as archives under path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    captures = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("sha", F.sha2("payload", 256))
    # written, so that the join deals both sides anew and splits a payload of very many pages
    largest = cut_lineage(captures.groupBy("sha").agg(F.max("id").alias("first")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    new = row["id"] == row["first"] or len(row["payload"]) < min_revisit_bytes
                    record = build_record(row["id"], row["url"], row["payload"], row["first"], new, date)
                    out.append(member(record)[:-1])
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    rows = captures.join(largest, "sha").select("id", "url", "payload", "first")
    (
        rows.mapInArrow(members, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\u0000")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


# ---- reading ---------------------------------------------------------------------------


def inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a place, or None if it doesn't pass its checks."""
    opener, parts, step = zlib.decompressobj(31), [], 2048
    try:
        while at < len(data) and not opener.eof:
            piece = data[at : at + step]
            parts.append(opener.decompress(piece))
            at += len(piece)
            step = min(2 * step, _STEP)
    except zlib.error:
        return None
    return (b"".join(parts), at - len(opener.unused_data)) if opener.eof else None


def parse_record(data, at: int) -> tuple[dict, bytes, int] | None:
    """(headers, block, end) of the plain record at a place, or None if a check fails."""
    if bytes(data[at : at + 7]) != b"WARC/1.":
        return None
    head_end, step = -1, 4096
    while head_end < 0 and step <= 1 << 22:  # headers are looked for in growing pieces
        head = bytes(data[at : at + step])
        head_end = head.find(b"\r\n\r\n")
        if head_end < 0 and at + step >= len(data):
            return None
        step *= 4
    if head_end < 0:
        return None
    headers = {}
    for line in head[:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return None
    start = at + head_end + 4
    end = start + int(headers["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        return None
    block = bytes(data[start:end])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != sha1_base32(block):
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and stated.startswith("sha1:") and stated[5:] != sha1_base32(payload):
        return None
    return headers, block, end + 4


def _partly(data: memoryview, at: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What inflates of a damaged gzip member, and pairs of (bytes inflated, bytes read up to here)."""
    opener, parts, marks, step = zlib.decompressobj(31), [], [(0, at)], 4096
    while at < len(data) and not opener.eof:
        held = opener.copy()
        try:
            parts.append(opener.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            opener, step = held, 1  # up to the very byte
            continue
        at = min(at + step, len(data))
        marks.append((marks[-1][0] + len(parts[-1]), at))
    return b"".join(parts), marks


def _read_for(data: memoryview, size: int, marks: list[tuple[int, int]]) -> int:
    """The place up to which a member is read when so many bytes of it are inflated."""
    last = max(i for i, (held, _) in enumerate(marks) if held < size)
    opener = zlib.decompressobj(31)
    for (_, a), (_, b) in zip(marks[:last], marks[1 : last + 1]):
        opener.decompress(data[a:b])
    held, at = marks[last]
    while held < size:
        held += len(opener.decompress(data[at : at + 1]))
        at += 1
    return at


_SIGN = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_LINE = re.compile(rb"WARC/1\.")


def _inside(content: bytes) -> tuple[list[tuple[dict | None, bytes]], int]:
    """Records of inflated bytes and the gaps between them (no headers, the bytes), up to the last record
    that passes; the place after it."""
    out, at, end = [], 0, 0
    while at < len(content):
        one = parse_record(content, at)
        if one is None:
            sign = _LINE.search(content, at + 1)
            at = sign.start() if sign else len(content)
            continue
        if at > end:
            out.append((None, content[end:at]))
        out.append(one[:2])
        at = end = one[2]
    return out, end


def _taken(data: memoryview, at: int) -> tuple[list[tuple[dict | None, bytes]], int] | None:
    """Records of the member or plain record at a place, with gaps between them, and its end; None if no
    record passes."""
    if bytes(data[at : at + 2]) == b"\x1f\x8b":
        found = inflate(data, at)
        if found is None:
            content, marks = _partly(data, at)
            records, size = _inside(content)
            return (records, _read_for(data, size, marks)) if records else None
        content, end = found
        records, size = _inside(content)
        if content and not records:
            return None
        if size < len(content):
            records.append((None, content[size:]))
        return records, end
    one = parse_record(data, at)
    return one and ([one[:2]], one[2])


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | None, bytes]]:
    """(start, end, headers, block) of every record that passes, headers None for a gap; a gap in a member
    has the member's place and the inflated bytes."""
    data, at, gap = memoryview(content), 0, None
    while at < len(data):
        found = _taken(data, at)
        if found is None:
            gap = at if gap is None else gap
            sign = _SIGN.search(content, at + 1)
            at = sign.start() if sign else len(data)
            continue
        if gap is not None:
            yield gap, at, None, b""
            gap = None
        for headers, block in found[0]:
            yield at, found[1], headers, block
        at = found[1]
    if gap is not None:
        yield gap, len(data), None, b""


_FOUND = (
    "file string, start long, length long, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record, and one with record_type 'gap' per quarantined range of bytes; in a gap within a
    member payload_bytes counts its inflated bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FOUND.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column("path")[i].as_py(), [], 0
                for start, end, headers, block in salvage(batch.column("content")[i].as_py()):
                    if headers is None:
                        rows.append((file, start, end - start, "gap", *[None] * 4, len(block) or None, None))
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
                    kind = headers.get("warc-type")
                    size = int(length[1]) if length and kind == "revisit" else len(payload)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((
                        file, start, end - start, kind, headers.get("warc-record-id"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"), digest, size, payload if payloads and kind != "revisit" else None,
                    ))
                    held += len(payload) * payloads + 400
                    if held > _STEP * 64:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, _FOUND)
