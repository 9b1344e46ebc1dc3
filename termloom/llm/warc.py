"""WARC archives: a writer of gzip members, one a record, and a reader that salvages damaged files.

Archives are written by Spark's text writer, a file a row of bounded bytes; the separator it adds is an
empty gzip member, so each file is a plain sequence of members. The reader checks each record (gzip checksum,
version line, length, block and payload digests, end mark). After a failed check it looks for the next
valid member or version line, goes on from there and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.skew import join_hot
from termloom.session import scratch_dir, staged

#: An empty gzip member.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0]) + bytes(8)
#: Compressed bytes from which an archive ends, and records it holds at most.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 24_000_000, 20_000
#: Repeated payloads up to this number are sent to all tasks, at about 100 bytes each; more are joined.
BROADCAST_ROWS = 100_000
#: Lines a header has at most.
HEADER_LINES = 200
#: What a damaged archive's member may inflate to: no more fits in a row.
LARGEST = (1 << 31) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION = re.compile(rb"WARC/1\.\d{1,9}[ \t]{0,9}\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One uncompressed record. A revisit has the payload's HTTP head and digest but not the payload."""
    own = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda of: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{of}:{own}')}>"
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    if page_id is not None:
        fields["WARC-X-Page-ID"] = str(page_id)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)} | ({} if refers_to is None else {"WARC-X-Refers-To-Page-ID": str(refers_to)})
    fields |= {"WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write a record for each row of pages(page_id, url, html) and return the folder of the archives.

    Of rows with equal payloads of at least min_bytes bytes, those with the largest page_id are
    responses and others revisit it. Null html is an empty payload; a null page_id counts as least;
    extra columns are ignored; an empty table gives no archive. The table is scanned twice, for digests
    and to write; a third time where more than BROADCAST_ROWS payloads repeat. An archive has
    ARCHIVE_BYTES and its last record at most, so none outgrows what a row can hold by its number of records.
    """
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/termloom-warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    same = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), F.max(F.octet_length("html")).alias("bytes"))
    shared = same.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select("sha", "last", F.lit(True).alias("shared"), "n")
    shared = staged(shared, "digests")
    found = shared.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if found.keys <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared.drop("n")), "sha", "left")
    else:
        rows = join_hot(rows, shared, "sha", "n", found.rows, "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = lambda members: pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
        found, size = [], 0
        for b in batches:
            for page_id, url, html, refers_to, again in zip(*b.columns, strict=True):
                found.append(member(record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), again.as_py())))
                size += len(found[-1])
                if size >= ARCHIVE_BYTES or len(found) >= ARCHIVE_RECORDS:
                    yield archive(found)
                    found, size = [], 0
        if found:
            yield archive(found)

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return path


class Damaged(ValueError):
    """A failed check. end: where the damaged record ends if the length that it tells fits what follows, else None."""

    end: int | None = None


def _damaged(reason: str, data: bytes, end: int) -> Damaged:
    found = Damaged(reason)
    if data[end - 4 : end] == b"\r\n\r\n" and (end == len(data) or data.startswith((b"WARC/1.", b"\x1f\x8b"), end)):
        found.end = end
    return found


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of uncompressed data and the place after it; raises Damaged if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    fields, start = {}, version.end()
    for _ in range(HEADER_LINES):  # a line may be of any length; one that is none ends the search, so damaged data isn't read over and over
        end = data.find(b"\r\n", start)
        if end < 0:
            raise Damaged("no end of header")
        if end == start:
            break
        k, sep, v = data[start:end].partition(b":")
        if not sep:
            raise Damaged("header line")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        start = end + 2
    else:
        raise Damaged("header of too many lines")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("length")
    start, n = end + 2, int(fields["content-length"])
    block = data[start : start + n]
    if len(block) < n:
        raise Damaged("truncated")
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        raise Damaged("no end mark")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise _damaged("block digest", data, start + n + 4)
    head, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise _damaged("payload digest", data, start + n + 4)
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    return {
        "page_id": number("warc-x-page-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": number("warc-x-refers-to-page-id"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or digest(payload),
        "payload_bytes": int(length[1]) if fields.get("warc-type") == "revisit" and length else len(payload),
        "payload": payload,
    }, start + n + 4


def _inflate(data: memoryview) -> tuple[bytes, int, str | None]:
    """What the first gzip member holds, the bytes it takes and None; of a broken one what can be inflated, and the reason."""
    z = zlib.decompressobj(31)
    out, fed, size = [], 0, 0
    try:
        while not z.eof:
            part = data[fed : fed + 65536]
            if not len(part):
                return b"".join(out), fed, "truncated member"
            fed += len(part)
            out.append(z.decompress(part))
            size += len(out[-1])
            if size > LARGEST:
                return b"".join(out), fed, f"member of more than {LARGEST} bytes"
    except zlib.error as e:
        z, last = zlib.decompressobj(31), fed - len(part)
        out = [z.decompress(data[at : min(at + 65536, last)]) for at in range(0, last, 65536)]
        try:
            for at in range(last, fed):  # byte by byte up to the damage
                out.append(z.decompress(data[at : at + 1]))
        except zlib.error:
            pass
        return b"".join(out), at, "member checksum" if "check" in str(e) else "member"
    return b"".join(out), fed - len(z.unused_data), None


def _records(raw: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of each valid record of a member's content and (start, end, None, reason) of what lies between."""
    at, gap, reason = 0, None, ""
    while at < len(raw):
        try:
            r, end = parse_record(raw, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = e.end or raw.find(b"WARC/1.", at + 1)  # what stands within a damaged record isn't a record
            at = len(raw) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield at, end, r, None
        at = end
    if gap is not None:
        yield gap, len(raw), None, reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of each valid record and (start, end, None, reason) of each gap, in order; together with empty members they cover data.

    Records of one member share its place, and so do the gaps between them, whose reasons tell the bytes
    of its content. Records saved from a broken member have its start as their end too; the gap that
    covers its bytes follows.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""
    saved: set[bytes] = set()  # of the broken members in the gap: stored bytes are seen again by the search
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                raw, n, broken = _inflate(view[at:])
                found = list(_records(raw))
                valid = [x for x in found if x[2]]
                if broken or (found and not valid):
                    new = [x for x in valid if raw[x[0] : x[1]] not in saved]
                    if new and gap is not None and gap < at:
                        yield gap, at, None, reason
                        gap = None
                    for s, e, r, _ in new:
                        saved.add(raw[s:e])
                        yield at, at, r, None
                    raise Damaged(broken or found[0][3])
                end = at + n
            else:
                r, end = parse_record(data, at)
                found = [] if data[at:end] in saved else [(at, end, r, None)]
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            m = None if e.end else _NEXT.search(data, at + 1)
            at = e.end or (m.start() if m else len(data))
            continue
        if gap is not None and found:
            yield gap, at, None, reason
            gap, saved = None, set()
        for s, e, r, why in found:
            yield at, end, r, why and f"{why} (bytes {s} to {e} of the member's content)"
        at = end
    if gap is not None:
        yield gap, len(data), None, reason


ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, start long, end long, gap string"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records (gap null) and quarantined gaps (gap: the reason; only archive, start, end besides) of the archives in a folder and its subfolders.

    After a damaged record whose length fits what follows, the search goes on behind it, so a record that
    stands in its payload is not taken for one of the archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for start, end, r, why in salvage(content.as_py()):
                    if r and not with_payload:
                        r["payload"] = None
                    rows.append((r or {}) | {"archive": name.as_py(), "start": start, "end": end, "gap": why})
                    size += 200 + len((r or {}).get("payload") or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ROWS)
