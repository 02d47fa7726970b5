"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Every page is one HTTP response in chunked transfer framing. A payload seen before is a revisit record
that names the response record with the same payload. A block longer than a segment is split: the first piece
is the record itself, the others are continuation records that carry the first one's id, their number and,
on the last, the total length. Archives are rows of gzip members, so any store that holds a binary column
holds them. Records are named by page, payload digest and copy, so the name of a response is known before
it is written.

Scale: equal payloads meet as digests, aggregated before the shuffle; pages are shuffled once, by id, next
to their verdicts. Reading parses each archive where it lies, once for whole records and once for the pieces
of split ones; only those pieces are shuffled, grouped by the id of their origin, so a group is one page. A
revisit is held against the response it names by a join of names, digests and lengths. Archives are cut at
ARCHIVE_BYTES.

Defined cases: null html is an empty payload; payloads under MIN_REVISIT bytes are always responses; rows
that repeat a page_id with equal html are responses if that id is the largest of its payload; null page_id
ranks below all others; other columns of pages than page_id, url and html are not written; an empty table
gives no archive; wrong digests, lengths, numbering or framing, and revisits of a response that isn't there
or has another payload, raise WarcError (or Spark's own error with its words).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_batches

MIN_REVISIT = 1000
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES, BATCH_BYTES = 8192, 4096, 4 << 20, 8 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARTS = (
    "origin string, segment int, total long, piece binary, page_id long, url string, record_type string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


class WarcError(ValueError):
    """The archive breaks the format or its own digests and lengths."""


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk size is cut off")
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError as e:
            raise WarcError("a chunk size is no number") from e
        at = end + 2
        if n == 0:
            break
        if body[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2
    return b"".join(out)


def record_name(page_id: int | None, sha: str, copy: int = 1) -> str:
    """The id of a page's record; rows that repeat a page and its payload are numbered."""
    return f"<urn:page:{'' if page_id is None else page_id}:{sha}:{copy}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 1, segment: int = SEGMENT_BYTES, date: str = DATE) -> Iterator[bytes]:
    """The records of one page: one, or the first and its continuations."""
    sha = hashlib.sha1(payload).hexdigest()
    name = record_name(page_id, sha, copy)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
    common: list[tuple[str, object]] = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_name(refers_to, sha))], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}.{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), *last], piece)


def with_verdicts(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html of pages with refers_to, the largest page_id of an equal payload of at least `least`
    bytes, if another, and copy, which numbers the rows that repeat a page and its payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    here = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("sha", F.sha1(payload))
    here = here.withColumn("page", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), "sha"))
    large = here.filter(F.octet_length(payload) >= least).select("page_id", "sha", "page")
    best = large.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = large.join(best, "sha").filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    rows = here.join(again.select("page", "refers_to").dropDuplicates(["page"]), "page", "left")
    # the rows of a page are together by now; they are numbered where they lie
    return rows.select("page_id", "url", "html", "refers_to", F.row_number().over(Window.partitionBy("page").orderBy("url")).alias("copy"))


def write_archives(pages: DataFrame, least: int = MIN_REVISIT, segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """archive (a name) and content (gzip members) rows that hold all pages. Write them to a table before
    reading them more than once: which archive holds a page follows the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{part}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        held, size, files = [start], len(start), 0

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{files:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for batch in text_batches(batches, "html", BATCH_BYTES):
            for page, url, html, refers, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in page_records(page, url, (html or "").encode(), refers, copy, segment, date):
                    held.append(r)
                    size += len(r)
                    if size >= archive:
                        yield cut()
                        held, size, files = [start], len(start), files + 1
        if len(held) > 1:
            yield cut()

    return with_verdicts(pages, least).mapInArrow(run, "archive string, content binary")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of one archive."""
    data = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise WarcError("no record where one should start")
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        at = end + 4 + n + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise WarcError("a block has another length than its header says")
        yield head, data[end + 4 : end + 4 + n]


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def payload_of(block: bytes, digest: str, revisit: bool) -> tuple[bytes | None, int]:
    """The HTTP payload and its length; a revisit has the length only."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("no HTTP header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if revisit:
        return None, int(fields[b"content-length"])
    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise WarcError("the payload has another digest than its header says")
    return payload, len(payload)


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (hex SHA-1), payload_bytes and, if kept, payload."""

    def parse(split: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    chosen = ((head, block) for head, block in records(content) if ("warc-segment-number" in head) == split)
                    rows = [row for head, block in chosen if (row := parsed(head, block, keep_payload))]
                    yield as_batch(rows, _PARTS)

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    raise WarcError("the segments of a record are not 1 to the last")
                block = b"".join(p["piece"] for p in parts)
                if len(block) != parts[-1]["total"]:
                    raise WarcError("the segments have another total length than the last one says")
                payload, n = payload_of(block, parts[0]["payload_digest"], False)
                rows.append(parts[0] | {"origin": origin, "payload_bytes": n, "payload": payload if keep_payload else None})
            yield as_batch([{k: r[k] for k in names} for r in rows], out)

    names = ["origin", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * keep_payload
    kinds = dict(x.strip().split() for x in _PARTS.split(","))
    out = ", ".join(f"{n} {kinds[n]}" for n in names)
    content = archives.select("content")
    parts = content.mapInArrow(parse(True), _PARTS)
    piece = F.struct("segment", *[c for c in parts.columns if c not in ("origin", "segment")])
    grouped = parts.groupBy("origin").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    rows = stored(content.mapInArrow(parse(False), _PARTS).select(*names).unionByName(grouped.mapInArrow(finish, out)))
    return checked(rows).drop("origin")


def checked(rows: DataFrame) -> DataFrame:
    """rows with refers_to as a page_id; a record id that stands twice, and a revisit whose response isn't
    there or has another payload, is an error."""
    told = F.struct("payload_digest", "payload_bytes")
    ids = rows.groupBy("origin").agg(F.count("*").alias("times"), F.min(F.when(F.col("record_type") == "response", told)).alias("held"))
    twice = ids.filter("times > 1").select(F.col("origin").alias("twice"))
    named = rows.filter("refers_to is not null").select("origin", "refers_to", told.alias("told")).join(ids.select(F.col("origin").alias("refers_to"), "held"), "refers_to", "left")
    wrong = named.filter(F.coalesce(F.col("held") != F.col("told"), F.lit(True)))
    if not twice.isEmpty():
        raise WarcError(f"record id {twice.first().twice} stands twice")
    if not wrong.isEmpty():
        raise WarcError(f"{wrong.first().origin} revisits no response of its payload")
    page = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return rows.withColumn("refers_to", page)


def parsed(head: dict[str, str], block: bytes, keep: bool) -> dict | None:
    kind = head["warc-type"]
    row = dict.fromkeys(x.strip().split()[0] for x in _PARTS.split(","))
    if kind == "continuation":
        total = head.get("warc-segment-total-length")
        return row | {"origin": head["warc-segment-origin-id"], "segment": int(head["warc-segment-number"]), "total": int(total) if total else None, "piece": block}
    if kind not in ("response", "revisit"):
        return None
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    row |= {"origin": head["warc-record-id"], "page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": digest}
    if kind == "revisit":
        row["refers_to"] = head["warc-refers-to"]
    if "warc-segment-number" in head:
        return row | {"segment": 1, "piece": block}
    payload, n = payload_of(block, digest, kind == "revisit")
    return row | {"payload_bytes": n, "payload": payload if keep else None}


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def as_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])
