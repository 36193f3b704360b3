"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

Writing. Each page becomes a `response` record, an HTTP message whose body is sent in chunks, or, if an equal payload
belongs to a page with a smaller page_id, a `revisit` record that refers to that page. A record whose block is longer
than the segment size is split: the first segment keeps its type, `continuation` records follow with
WARC-Segment-Number and WARC-Segment-Origin-ID, and the last one has WARC-Segment-Total-Length. Records are gathered
into blocks of BLOCK_BYTES and written by Spark's text sink with the records' own terminator as line separator, so that
archives go to any file system that Spark knows, and no file exceeds about BLOCK_BYTES * BLOCKS_PER_FILE.

Reading. Each archive is one binaryFile row; records are cut out by Content-Length alone. Records without segments are
decoded at once; segments alone are shuffled: grouped by origin id, ordered by segment number, checked against the
total length, joined, and then decoded. A record's id holds the number of its row, so that a group has the segments of one
record, however often its page is repeated. A response's block is an HTTP message: its headers are parsed and chunked
framing is undone. A group with a missing, repeated or wrong-sized segment gives an error row, never a shorter payload.

Defined cases: null html is an empty payload; a null page_id has empty text in its header and is never the smallest; all
rows with the smallest page_id of their payload are responses; repeated rows give a record each; an empty table gives an
empty archive; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize, scratch_path

#: Bytes of a record's block beyond which it is segmented, of an HTTP chunk, of a text row, and rows in a file.
SEGMENT_BYTES, CHUNK_BYTES, BLOCK_BYTES, BLOCKS_PER_FILE = 65_536, 8_192, 4 << 20, 8

_END = b"\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes (at least 4), never within a UTF-8 character: the text sink needs whole characters."""
    pieces, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and (data[end] & 0xC0) == 0x80:
            end -= 1
        pieces.append(data[at:end])
        at = end
    return pieces


def http_message(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for piece in _cut(payload, chunk):
        out += (b"%x\r\n" % len(piece), piece, b"\r\n")
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def http_body(message: bytes) -> bytes:
    """The body of an HTTP message; chunked transfer framing is undone and checked."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return body
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        piece = body[line + 2 : line + 2 + n]
        if len(piece) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(piece)
        at = line + 4 + n


def record(kind: str, rid: str, fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    """A record without its terminator's last CRLF pair, which the sink writes."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", _DATE), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {str(v).translate(_FLAT)}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block


#: Line ends within a header's value would break the record.
_FLAT = {10: " ", 13: " "}


def page_records(page_id, url, payload: bytes, revisit_of, segment: int = SEGMENT_BYTES, number: int = 0, first_url: str | None = None) -> list[bytes]:
    """The records of one row; number tells rows with equal page_id and payload apart, first_url is the revisited page's."""
    digest = digest_of(payload)
    about = [("WARC-Target-URI", url or ""), ("X-Page-ID", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    rid = f"urn:page:{'' if page_id is None else page_id}:{digest}:{number}"
    if revisit_of is not None:
        ref = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", first_url or ""), ("X-Refers-To-Page", revisit_of)]
        return [record("revisit", rid, about + ref, b"")]
    block = http_message(payload)
    if len(block) <= segment:
        return [record("response", rid, [*about, ("Content-Type", "application/http; msgtype=response")], block)]
    parts, out = _cut(block, segment), []
    for k, part in enumerate(parts, 1):
        seg = [("WARC-Segment-Number", k)]
        if k > 1:
            seg.append(("WARC-Segment-Origin-ID", f"<{rid}>"))
        if k == len(parts):
            seg.append(("WARC-Segment-Total-Length", len(block)))
        own = [*about, ("Content-Type", "application/http; msgtype=response")] if k == 1 else []
        out.append(record("response" if k == 1 else "continuation", rid if k == 1 else f"{rid}:{k}", own + seg, part))
    return out


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Write a record for each row (page_id, url, html) to WARC files under path. Payloads under least_bytes are never revisits."""
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    first = slim.where(F.octet_length("html") >= least_bytes).groupBy(sha.alias("fsha")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # written first, so that its size is known when the join is planned: the texts are shuffled only where it is large
    first = materialize(first, "warc-first")
    tagged = slim.withColumn("sha", sha).join(first, F.col("sha") == F.col("fsha"), "left")
    mine = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("html") < least_bytes)
    tagged = tagged.select("page_id", "url", "html", F.when(~mine, F.col("first")).alias("revisit_of"), "first_url")

    def run(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for page_id, url, html, ref, first_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit_of", "first_url")), strict=True):
                number += 1
                for r in page_records(page_id, url, html.encode("utf-8", "replace"), ref, segment, number, first_url):
                    held.append(r)
                    size += len(r) + 4
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([_END.join(held).decode("utf-8", "replace")], pa.large_string())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(held).decode("utf-8", "replace")], pa.large_string())], ["value"])

    out = tagged.mapInArrow(run, "value string")
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)
    discard(first)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != _END:
            raise ValueError("a record's length is wrong")
        yield head, block
        at = end + 8 + n


_OUT = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string()), ("error", pa.string())])
_SEGMENT = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
_OUT_DDL = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, html string, error string"


def _decoded(head: dict, block: bytes, with_text: bool) -> tuple:
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    ids = (head.get("x-page-id") or None, head.get("warc-target-uri") or None)
    if head["warc-type"] == "revisit":
        return (*ids, "revisit", head.get("x-refers-to-page"), int(head.get("x-payload-length", 0)), said, None, None)
    try:
        payload = http_body(block)
    except ValueError as e:
        return (*ids, head["warc-type"], None, None, None, None, str(e))
    digest = digest_of(payload)
    return (*ids, head["warc-type"], None, len(payload), digest, payload.decode("utf-8", "replace") if with_text else None, None if digest == said or not said else "the payload's digest differs")


def read_archives(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """The pages of all archives under path: page_id, url, record_type, refers_to (as text), payload_bytes, payload_digest, html, error."""
    files = spark.read.format("binaryFile").load(path + "/part-*").select("content")

    def cut(batches):
        schema = pa.schema([*_OUT, *_SEGMENT])
        for b in batches:
            for i in range(b.num_rows):
                data, rows, held = zlib.decompress(b.column("content")[i].as_buffer(), 31), [], 0
                for head, block in parse_archive(data):
                    number = head.get("warc-segment-number")
                    if number is None:
                        rows.append((*_decoded(head, block, with_text), None, None, None, None))
                    else:
                        total = head.get("warc-segment-total-length")
                        origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
                        said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        own = (head.get("x-page-id") or None, head.get("warc-target-uri") or None, head["warc-type"], None, None, said, None, None)
                        rows.append((*own, origin, int(number), int(total) if total else None, block))
                    held += len(block)
                    if held >= BLOCK_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parsed = files.mapInArrow(cut, _OUT_DDL + ", origin string, number int, total bigint, block binary")
    columns = [f.name for f in _OUT]
    segments = parsed.where("origin is not null")

    def join_segments(key, tbl):
        rows = sorted(tbl.to_pylist(), key=lambda r: r["number"])
        return pa.Table.from_pylist([dict(zip(columns, reassemble(rows, with_text), strict=True))], schema=_OUT)

    whole = segments.groupBy("origin").applyInArrow(join_segments, _OUT_DDL)
    return parsed.where("origin is null").select(*columns).unionAll(whole)


def reassemble(rows: list[dict], with_text: bool = True) -> tuple:
    """One record from its segments, or an error row; rows are ordered by segment number."""
    head = rows[0]
    ids = (head["page_id"], head["url"], head["record_type"], None)
    block = b"".join(r["block"] for r in rows)
    if [r["number"] for r in rows] != list(range(1, len(rows) + 1)):
        return (*ids, None, None, None, "segments are missing or repeated")
    if rows[-1]["total"] != len(block):
        return (*ids, None, None, None, "the total length differs")
    about = {"x-page-id": head["page_id"], "warc-target-uri": head["url"], "warc-type": head["record_type"], "warc-payload-digest": head["payload_digest"] or ""}
    return _decoded(about, block, with_text)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back, one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, with_text=False)
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "error")


#: The archives' round trip gives what the pages say; base32 of a digest is spelled out, four letters for each five hexadecimal digits.
ORACLE = r"""
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha1(encode(html)) h from p),
f as (select h, min(page_id) first from d group by h)
select page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end record_type,
       case when page_id <> first or (page_id is null and first is not null) then first end refers_to,
       null::varchar as error
from d join f using (h)
"""
