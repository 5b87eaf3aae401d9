"""WARC archives: writing pages with revisit records, and a reader that salvages damaged files.

The writer leaves plain WARC/1.1 files through Spark's text sink, whose line separator is the end
of a record. The reader takes plain files and files of gzip members. Where a record fails its checks
it searches for the next valid member or version line, goes on there, and logs the bytes between
as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import maybe_in, membership_bitmap

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in an archive file, which a reader takes as a whole; and the payload bytes from which a
#: record has a file of its own. So a file has about a gigabyte at most, or one record.
RECORDS_PER_FILE = 2000
LARGE_PAYLOAD = 1 << 19
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_text(
    page_id: int | None, url: str | None, payload: str, digest: str, size: int, refers_to: int | None,
    date: str,
) -> str:
    """A response record, or without payload a revisit of ``refers_to``; its end is not included."""
    http = CRLF.join([
        "HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", "",
    ])
    kind = "response" if refers_to is None else "revisit"
    header = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        header.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
        payload, size = "", 0
    header += [
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size}", "", "",
    ]
    return CRLF.join(header) + http + payload


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    min_payload: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write one record per row to new archives in ``folder``.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the largest id are
    responses and the others revisit it. Null html is an empty payload. Rows without an id revisit
    a row that has one, and are responses where there is none; repeated rows each get a record. An
    empty table writes an archive without records; other columns are not read.

    Only pages whose digest may occur twice (by a bounded bitmap, which errs on the safe side) are
    shuffled, by id, never by their content.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"),
    )
    large = rows.where(F.col("size") >= min_payload).groupBy("digest").agg(
        F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
    twice = large.where("rows > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    bits = pages.sparkSession.sparkContext.broadcast(
        membership_bitmap(twice.select(F.xxhash64("digest").alias("code")), "code")
    )

    def split(may_repeat: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = maybe_in(bits.value, batch.column("code").to_numpy()) if batch.num_rows else np.empty(0, bool)
                yield batch.filter(pa.array(may if may_repeat else ~may)).select(["id", "url", "html"])

        coded = rows.select("id", "url", "html", F.xxhash64("digest").alias("code"))
        return coded.mapInArrow(run, "id long, url string, html string")

    # Id by id, which of the rows that may repeat are revisits; then their pages join by id.
    digest = F.sha1(F.col("html").cast("binary"))
    keyed = rows.where(F.col("size") >= min_payload).select("id", "digest").join(twice, "digest")
    revisits = keyed.where("NOT (id <=> refers_to)").select(
        F.col("id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    again = split(True).withColumn("digest", digest)
    again = again.join(
        revisits, again["id"].eqNullSafe(revisits["of"]) & (again["digest"] == revisits["of_digest"]), "left"
    ).select("id", "url", "html", "refers_to")
    once = split(False).withColumn("refers_to", F.lit(None).cast("long"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                body = html.encode("utf-8")
                out.append(record_text(i, url, html, payload_digest(body), len(body), refers, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    every, large_one = once.unionByName(again), F.octet_length("html") >= LARGE_PAYLOAD
    parts = [(every.where(~large_one), RECORDS_PER_FILE)]
    if rows.where(F.col("size") >= LARGE_PAYLOAD).limit(1).count():
        parts.append((every.where(large_one), 1))
    for mode, (part, most) in zip(("errorifexists", "append"), parts):
        made = part.mapInArrow(records, "value string")
        made.write.mode(mode).option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(folder)


# ---- reading ---------------------------------------------------------------------------------


@dataclass
class Entry:
    """A record, or with ``error`` a quarantined range of bytes."""

    start: int
    end: int
    headers: dict[str, str]
    payload: bytes = b""
    payload_size: int | None = None
    error: str | None = None


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> Entry:
    """The record at a place in the data, with all checks; raises ``Damaged``."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[at:head_end].decode("utf-8", "replace").split(CRLF)[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("malformed header")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        raise Damaged("header without type or length")
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not lead to the end of a record")
    block = data[start:end]
    payload, size = block, None
    if headers.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Damaged("http header without end")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(said[1]) if said else None
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit":
        if size is not None and size != len(payload):
            raise Damaged("payload of another length")
        size = len(payload)
        if digest.startswith("sha1:") and digest[5:] != payload_digest(payload):
            raise Damaged("payload of another digest")
    return Entry(at, end + 4, headers, payload, size)


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at a place. With an error, the content up to the damage."""
    unzip, found, piece = zlib.decompressobj(31), [], 1 << 16
    for k in range(at, len(data), piece):
        before = unzip.copy()
        try:
            found.append(unzip.decompress(data[k : k + piece]))
        except zlib.error as error:
            try:
                for j in range(k, min(k + piece, len(data))):
                    found.append(before.decompress(data[j : j + 1]))
            except zlib.error:
                pass
            return b"".join(found), len(data), f"gzip: {error}"
        if unzip.eof:
            return b"".join(found), min(k + piece, len(data)) - len(unzip.unused_data), None
    return b"".join(found), len(data), "gzip member without end"


def _read(data: bytes, at: int, zipped: bool) -> tuple[list[Entry], int]:
    """The records at a place, or in the gzip member there, and the end; raises ``Damaged`` if there
    is none. Those of a member all have its bytes as their range."""
    if not zipped or not data.startswith(_GZIP, at):
        entry = parse_record(data, at)
        return [entry], entry.end
    content, end, error = _member(data, at)
    entries = list(salvage(content, zipped=False))
    if error is not None:
        entries = [e for e in entries if not e.error]
        end = _next_start(data, at + 1, zipped)
    if all(e.error for e in entries):
        raise Damaged(error or (entries[0].error if entries else "empty gzip member"))
    if error is not None:
        entries.append(Entry(at, end, {}, error=error))
    for entry in entries:
        entry.start, entry.end = at, end
    return entries, end


def _next_start(data: bytes, at: int, zipped: bool) -> int:
    """The next place where a member or a version line begins."""
    member = data.find(_GZIP, at) if zipped else -1
    line = _VERSION.search(data, at)
    found = [p for p in (member, line.start() if line else -1) if p >= 0]
    return min(found, default=len(data))


def salvage(data: bytes, zipped: bool = True) -> Iterator[Entry]:
    """All valid records of an archive in order, and between them the gaps that failed. Unless
    ``zipped`` is false, also those in gzip members, of a torn one up to the damage."""
    at, bad_from, reason = 0, None, ""
    while at < len(data):
        try:
            entries, end = _read(data, at, zipped)
        except Damaged as error:
            if bad_from is None:
                bad_from, reason = at, str(error)
            at = _next_start(data, at + 1, zipped)
            continue
        if bad_from is not None:
            yield Entry(bad_from, at, {}, error=reason)
            bad_from = None
        yield from entries
        at = end
    if bad_from is not None:
        yield Entry(bad_from, len(data), {}, error=reason)


_ENTRY = (
    "archive string, start long, end long, error string, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """One row per record and per quarantined gap of the archives in ``folder``: archive, start, end,
    error (null for records), record_type, record_id, refers_to, target_uri, payload_digest (without
    its prefix), payload_bytes (of revisits: as their HTTP header says) and payload (null if not
    wanted).

    A file is read whole by one task, so its size bounds the memory needed (``RECORDS_PER_FILE``
    bounds those written here). Empty files have no rows; an archive without one valid record is
    one gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                found = list(salvage(content.as_py() or b""))
                for k in range(0, len(found), 500):
                    yield _rows(path.as_py(), found[k : k + 500], payloads)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, _ENTRY)


def _rows(path: str, entries: list[Entry], payloads: bool) -> pa.RecordBatch:
    get = lambda name: [e.headers.get(name) for e in entries]
    digests = [d.partition(":")[2] if d else None for d in get("warc-payload-digest")]
    columns = {
        "archive": pa.array([path] * len(entries), pa.string()),
        "start": pa.array([e.start for e in entries], pa.int64()),
        "end": pa.array([e.end for e in entries], pa.int64()),
        "error": pa.array([e.error for e in entries], pa.string()),
        "record_type": pa.array(get("warc-type"), pa.string()),
        "record_id": pa.array(get("warc-record-id"), pa.string()),
        "refers_to": pa.array(get("warc-refers-to"), pa.string()),
        "target_uri": pa.array(get("warc-target-uri"), pa.string()),
        "payload_digest": pa.array(digests, pa.string()),
        "payload_bytes": pa.array([e.payload_size for e in entries], pa.int64()),
        "payload": pa.array([e.payload if payloads and not e.error else None for e in entries], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def page_number(name: str) -> Column:
    """The id in the name of a record; null if it has none."""
    return F.nullif(F.regexp_extract(name, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
