"""WARC archives: writing with deduplicated payloads, and a salvage reader.

Archives are written by Spark's text sink and read by its binary-file source,
so they can lie in any store that Spark reaches. The text sink ends every row
with a separator; a gzip member of under 16 MiB ends with a zero byte (the top
byte of its length), so members are written without their last byte and with a
zero byte as the separator. The files are plain record-compressed WARC files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_batches, spread_join

#: Equal payloads of at least so many bytes are archived once; the others refer to that record.
REVISIT_BYTES = 100
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Rows in one archive file.
FILE_ROWS = 2000
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of an archive that the decompressor sees at a time.
STEP = 1 << 16
#: Spark's binary-file source hands over whole files, up to this size; larger ones are quarantined whole.
ARCHIVE_BYTES = (1 << 31) - 1


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp; a further empty member follows if the last byte would not be zero."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + gzip_member(b"")


def build_record(kind: str, page_id: str, uri: str, payload: bytes, length: int, digest: str, refers_to: str | None) -> bytes:
    """A WARC record; a revisit has the HTTP head alone, which states the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", uri)
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Page-ID: {page_id}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            payload = (r.payload or "").encode("utf-8", "surrogatepass")
            rec = build_record(r.kind, "" if pd.isna(r.id) else str(r.id), r.uri or "", payload, len(payload), r.digest, None if pd.isna(r.refers) else str(r.refers))
            out.append(gzip_member(rec)[:-1])
        yield pd.DataFrame({"value": out})


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Archive every row of ``pages`` as one record-compressed WARC file per task.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the
    smallest id are responses and the others revisits of it; smaller payloads
    are responses. Null payloads are empty. A null id is archived as an empty
    one and orders after all others. Payloads are shuffled once at most, by
    their digest; of the digests only the repeated ones are joined, and rows of
    one that very many share are spread by their ids.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(uri_col).alias("uri"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    seen = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    j = spread_join(rows, materialize(seen, "warc-seen"), ["digest"], "n", F.col("id"))
    again = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))
    j = j.select("id", "uri", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first").cast("string")).alias("refers"))
    lines = j.mapInPandas(_members, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _number(text: str | None) -> int | None:
    """A length of ASCII digits; None for anything else, and for more digits than any file has bytes."""
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text) else None


class _Plain:
    """Records in uncompressed bytes. Ends of heads are sought once over the same bytes, however many version lines there are."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.blank = -1  # the next empty line

    def _head(self, at: int) -> tuple[dict[str, str], int] | None:
        """Fields of the head at ``at`` and the offset of its block; None at its first malformed line."""
        if self.blank < at:
            k = self.data.find(b"\r\n\r\n", at)
            self.blank = len(self.data) if k < 0 else k
        if self.blank == len(self.data):
            return None
        out, pos = {}, self.data.find(b"\r\n", at) + 2
        while pos <= self.blank:
            stop = self.data.find(b"\r\n", pos)
            name, colon, value = self.data[pos:stop].partition(b":")
            if not colon or not name.strip():
                return None
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            pos = stop + 2
        return out, self.blank + 4

    def record(self, at: int) -> tuple[dict[str, str], bytes, int] | str:
        """Fields, block and end of the record at ``at``, or why there is none."""
        data = self.data
        if not _VERSION_LINE.match(data, at):
            return "no version line"
        head = self._head(at)
        size = _number(head[0].get("content-length")) if head else None
        if size is None or "warc-type" not in head[0]:
            return "bad header"
        fields, start = head
        stop = start + size
        if stop > len(data):
            return "truncated block"
        if data[stop : stop + 4] != b"\r\n\r\n":
            return "no record end"
        block = data[start:stop]
        digest = fields.get("warc-block-digest", "")
        if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:].lower():
            return "block digest differs"
        return fields, block, stop + 4


def parse_records(data: bytes, member: tuple[int, int] | None = None) -> Iterator[tuple]:
    """('record', start, end, fields, block) and ('gap', start, end, reason) for uncompressed WARC bytes.

    After a failed check the next version line is sought and the bytes up to it
    are reported as a gap; a record counts as good only if its length leads to
    the record end and its block digest, if it has one, agrees. Offsets are
    those of ``data``, or all those of the ``member`` if given.
    """
    n, plain = len(data), _Plain(data)
    span = (lambda a, b: (a, b)) if member is None else (lambda a, b: member)
    at, bad, why = 0, None, ""
    while at < n:
        got = plain.record(at)
        if not isinstance(got, str):
            if bad is not None:
                yield ("gap", *span(bad, at), why)
                bad = None
            yield ("record", *span(at, got[2]), got[0], got[1])
            at = got[2]
            continue
        if bad is None:
            bad, why = at, got
        m = _VERSION_LINE.search(data, at + 1)
        at = m.start() if m else n
    if bad is not None:
        yield ("gap", *span(bad, n), why)


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` and the offset after it; None if it fails its checks.

    The decompressor sees STEP bytes at a time, so what it leaves unused, and
    copies, is never more than that.
    """
    d, parts, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not d.eof and at < len(data):
            parts.append(d.decompress(view[at : at + STEP]))
            at += STEP
    except zlib.error:
        return None
    return (b"".join(parts), min(at, len(data)) - len(d.unused_data)) if d.eof else None


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and quarantined gaps of one archive, compressed by record, plain or mixed.

    Every offset may hold a gzip member or a plain record. Where neither passes
    its checks, the nearest gzip magic or version line that follows is tried;
    so damage costs only the records that it touches, wherever it lies. Damage
    inside a member's WARC record is a gap over it. A whole member without any
    record that lies in damaged bytes (a compressed body) is part of their gap.
    Spans are those of the file; gaps and records (the members that hold them)
    cover it without holes, but for empty members.
    """
    at, bad, why = 0, None, ""
    n, plain = len(data), _Plain(data)
    magic = version = -1  # the next of each, so that neither is sought twice over the same bytes
    while at < n:
        found = None
        if data.startswith(MAGIC, at):
            got, reason = _inflate(data, at), "damaged member"
            if got is not None:
                found, end = list(parse_records(got[0], member=(at, got[1]))), got[1]
                if bad is not None and found and all(x[0] == "gap" for x in found):
                    at = end
                    continue
        else:
            got = reason = plain.record(at)
            if not isinstance(got, str):
                found, end = [("record", at, got[2], got[0], got[1])], got[2]
        if found is not None:
            if bad is not None:
                yield ("gap", bad, at, why)
                bad = None
            yield from found
            at = end
            continue
        if bad is None:
            bad, why = at, reason
        if magic <= at:
            magic = data.find(MAGIC, at + 1)
            magic = n if magic < 0 else magic
        if version <= at:
            m = _VERSION_LINE.search(data, at + 1)
            version = m.start() if m else n
        at = min(magic, version)
    if bad is not None:
        yield ("gap", bad, n, why)


RECORD_SCHEMA = "path string, status string, offset long, gap_end long, reason string, record_type string, page_id string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"


def _read(keep_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, held = [], 0
                for x in salvage(bytes(content)):
                    if x[0] == "gap":
                        rows.append((path, "quarantined", x[1], x[2], x[3], *[None] * 8))
                    else:
                        _, off, _, f, block = x
                        head, _, body = block.partition(b"\r\n\r\n")
                        said = f.get("warc-payload-digest", "").removeprefix("sha256:")
                        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
                        if f["warc-type"] == "revisit":
                            size, digest, ok = int(m[1]) if m else None, said, None
                        else:
                            size, digest = len(body), hashlib.sha256(body).hexdigest()
                            ok = digest == said
                        rows.append((path, "ok", off, None, None, f["warc-type"], f.get("warc-page-id"), f.get("warc-target-uri"), f.get("warc-refers-to-page-id"), body if keep_payload and f["warc-type"] == "response" else None, size, digest, ok))
                        held += len(body)
                    if len(rows) >= 500 or held > 16_000_000:
                        yield pd.DataFrame(rows, columns=names).astype(object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record (status ok) and per damaged byte range (status quarantined) of the archives under ``path``.

    Truncated, overwritten or interleaved bytes never fail the job: later
    records are recovered, and gaps give [offset, gap_end) with a reason. An
    archive file is one unit of work, read in one pass; its task holds it whole
    (once in Spark, once in Python) and one record's text. The writer keeps
    files small. Files above ARCHIVE_BYTES, which Spark cannot hand over, are
    one quarantined row each.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    got = files.where(F.col("length") <= ARCHIVE_BYTES).select("path", "content").mapInPandas(_read(keep_payload), RECORD_SCHEMA)
    told = {"path": F.col("path"), "status": F.lit("quarantined"), "offset": F.lit(0).cast("long"), "gap_end": F.col("length"), "reason": F.lit("archive too large")}
    big = files.where(F.col("length") > ARCHIVE_BYTES).select(*[told.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in got.schema.fields])
    return got.unionByName(big)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, ...

    The archives go to ``path`` or a new folder beside the checkpoints.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    got = read_warc(spark, path).where("status = 'ok'")
    return got.select(F.expr(f"try_cast(page_id as {kind})").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr(f"try_cast(refers_to as {kind})").alias("refers_to"), "uri", "digest_ok")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d
)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
