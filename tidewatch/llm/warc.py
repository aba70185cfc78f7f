"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle
from .common import read_blobs, write_blobs

ROLL_BYTES = 16 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
NIL = 0xFFFFFFFFFFFFFFFF  # low half of the record id of a page without an id
RECORD = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512}
GAP = "file string, offset long, length long, reason string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    low = NIL if page_id is None else page_id & 0xFFFFFFFFFFFFFFFF
    return f"<urn:uuid:{uuid.UUID(int=(0x7469646577617463 << 64) | low)}>"


def page_of(urn: str | None) -> int | None:
    """The page id inside one of our record ids; null for others."""
    try:
        number = uuid.UUID(urn.strip().removeprefix("<urn:uuid:").removesuffix(">")).int
    except (AttributeError, ValueError):
        return None
    low = number & 0xFFFFFFFFFFFFFFFF
    if number >> 64 != 0x7469646577617463 or low == NIL:
        return None
    return low - (1 << 64) if low >> 63 else low


def build_record(page_id, url, payload: bytes, sha: str, refers_to, revisit: bool) -> bytes:
    """One record. A revisit has the same HTTP head as a response, length included, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {clean}"] if clean is not None else []
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` as gzip members, in files of about ``roll_bytes``.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of ``min_bytes`` or more, the
    smallest page_id is a response and the others revisit it; a row without a page_id counts as the largest, and exact
    repeats of the smallest are all responses. Only digests meet in a shuffle: many copies of one payload are summed
    up before it, and the join back may be split wherever one digest is frequent.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keys = settle(rows.select("sha", "page_id", F.length("payload").alias("size")))
    firsts = keys.filter(F.col("size") >= min_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    revisits = settle(keys.filter(F.col("size") >= min_bytes).join(settle(firsts), "sha").filter("not page_id <=> first"))
    # By page id and digest, which pages hardly share: what is large moves once and evenly.
    known = revisits.select("page_id", "sha", "first", F.lit(True).alias("revisit")).distinct()
    same = rows["page_id"].eqNullSafe(known["page_id"]) & (rows["sha"] == known["sha"])
    marked = rows.join(known, same, "left").select(rows["*"], "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, done = bytearray(), lambda: pa.record_batch([pa.array([bytes(blob)], pa.binary())], names=["blob"])
        for batch in batches:
            for page_id, url, data, sha, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                named = base64.b32encode(bytes.fromhex(sha)).decode()
                blob += gzip_member(build_record(page_id, url, data, named, first, bool(revisit)))
                if len(blob) >= roll_bytes:
                    yield done()
                    blob = bytearray()
        if blob:
            yield done()

    write_blobs(marked.mapInArrow(run, "blob binary"), path)


def differs(told: str | None, data: bytes) -> bool:
    """Whether a digest header contradicts ``data``. Base 32 and hex in either case are read; what is neither, or names an
    algorithm that is not known here, proves nothing."""
    name, colon, value = (told or "").partition(":")
    known = DIGESTS.get(name.strip().lower().replace("-", "")) if colon else None
    if known is None:
        return False
    made, value = known(data).digest(), value.strip()
    spelt = {2 * len(made): made.hex(), len(base64.b32encode(made).rstrip(b"=")): base64.b32encode(made).decode().rstrip("=").lower()}
    plain = value.rstrip("=").lower()
    return len(plain) in spelt and plain != spelt[len(plain)]


def parse_record(data: bytes, at: int = 0) -> tuple[dict | None, int, str]:
    """The record whose version line starts at ``at``: (fields or None, end, reason). Length and digests must hold."""
    version = VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None, at, "header does not end"
    fields = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    start = head_end + 4
    if not size.isdigit() or start + int(size) > len(data):
        return None, at, "content length is wrong"
    block = data[start : start + int(size)]
    end = start + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "record does not end where its length says"
    if differs(fields.get("warc-block-digest"), block):
        return None, at, "block digest differs"
    http, blank, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:") or digest(body)
    if kind == "response" and differs(fields.get("warc-payload-digest"), body):
        return None, at, "payload digest differs"
    told = re.search(rb"(?im)^content-length: *(\d+)", http)
    return {
        "page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": page_of(fields.get("warc-refers-to")), "payload_digest": sha,
        "payload_bytes": int(told[1]) if kind == "revisit" and told else len(body), "payload": body,
    }, end + 4, ""


def _inflate(content: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` gives before any damage, and where it ends; None if it is damaged or breaks off."""
    opened, parts = zlib.decompressobj(31), []
    while not opened.eof and at < len(content):
        before = opened.copy() if parts else zlib.decompressobj(31)
        try:
            parts.append(opened.decompress(content[at : at + 65536]))
        except zlib.error:  # the part again in small steps, for what comes before the damage
            step = 64
            for k in range(at, min(at + 65536, len(content)), step):
                try:
                    parts.append(before.decompress(content[k : k + step]))
                except zlib.error:
                    break
            return b"".join(parts), None
        at += min(65536, len(content) - at)
    return b"".join(parts), at - len(opened.unused_data) if opened.eof else None


def _inside(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of inflated data, and the gaps ``(offset, length, reason)`` between them, in inflated bytes."""
    found, gaps, at, start, reason = [], [], 0, None, ""
    while at < len(data):
        fields, end, why = parse_record(data, at)
        if fields is not None:
            if start is not None:
                gaps.append((start, at - start, reason))
                start = None
            found.append(fields)
            at = end
            continue
        if start is None:
            start, reason = at, why
        later = VERSION.search(data, at + 1)
        at = later.start() if later else len(data)
    if start is not None:
        gaps.append((start, len(data) - start, reason))
    return found, gaps


def salvage(content: bytes) -> Iterator[tuple[str, int, object]]:
    """``("record", offset, fields)`` and ``("gap", offset, (length, reason))`` of an archive, plain or gzip members.

    After a failed check it goes on at the next place where a member or a version line starts and proves valid.
    What lies between is reported as a gap, byte for byte; zero bytes at the end are padding. Inside a member the same
    search runs over the inflated data: each of its gaps is reported at the member's offset, with its place and length
    there in the reason and a length of 0, as the member's bytes are not lost. Of a member that is damaged or breaks
    off, the records before the damage come back, and its bytes are a gap.
    """
    size = len(content.rstrip(b"\0"))
    start, reason, at = None, "", 0  # of the open gap
    starts = re.compile(re.escape(MEMBER) + rb"|WARC/1\.[01]\r?\n")
    view = memoryview(content)
    while at < size:
        found, inner, end, why = [], [], at, "no member or version line"
        if content.startswith(MEMBER, at):
            data, after = _inflate(view, at)
            found, inner = _inside(data)
            why = "member is damaged" if after is None else inner[0][2] if inner else ""
            if after is not None and (found or not data):
                end = after
        elif VERSION.match(content, at):
            fields, after, why = parse_record(content, at)
            if fields is not None:
                found, end = [fields], after
        if (end > at or found) and start is not None:
            yield "gap", start, (at - start, reason)
            start = None
        yield from (("record", at, f) for f in found)
        if end > at:
            yield from (("gap", at, (0, f"{why} inside a member: {n} bytes from {k}")) for k, n, why in inner)
            at = end
            continue
        if start is None:
            start, reason = at, why
        later = starts.search(content, at + 1)
        at = later.start() if later else size
    if start is not None:
        yield "gap", start, (size - start, reason)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(records, gaps)`` of the archives in a folder; an archive is read whole by one task.

    Records: ``file, offset, page_id, url, record_type, refers_to, payload_digest, payload_bytes`` and ``payload``.
    Gaps: ``file, offset, length, reason`` of the quarantined bytes. Empty files and folders give no rows.
    """

    def rows(kind: str, schema: str):
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        batch = lambda held: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for files in batches:
                for name, content in zip(files.column(0).to_pylist(), files.column(1)):
                    held, size = [], 0
                    for what, at, got in salvage(content.as_py()):
                        if what != kind:
                            continue
                        held.append((name, at, *(got if what == "gap" else [got[n] for n in names[2:]])))
                        size += len(got["payload"]) if payload and what == "record" else 100
                        if size > (8 << 20):
                            yield batch(held)
                            held, size = [], 0
                    if held:
                        yield batch(held)

        return run, schema

    blobs = read_blobs(spark, path).select("path", "content")
    record_schema = RECORD if payload else RECORD.removesuffix(", payload binary")
    return blobs.mapInArrow(*rows("record", record_schema)), blobs.mapInArrow(*rows("gap", GAP))
