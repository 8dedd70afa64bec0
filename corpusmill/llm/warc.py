"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Spark's text writer puts the records into files, so a lost task only repeats its own file. The reader walks through a
file record by record, plain or in gzip members. Where a check fails (version line, headers, length, end of record, block
digest, member checksum) it searches for the next place at which a whole record passes them all, goes on there, and reports
the bytes between as a gap.

Null payloads are empty. A null page_id is archived under the id "null", never revisits and is never revisited. Rows with
the largest page_id of a payload are all responses. Null URLs get a URN. Texts of any length are stored whole. An empty
table gives an archive without records. Further columns are ignored, so names may clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, work_dir

#: Smaller payloads are always stored.
LEAST_REVISITED = 1000
#: Bytes of payload in one file, about; pages of LONG times the mean length and more are filed apart.
FILE_BYTES, LONG = 64 << 20, 16
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORD_ID = "urn:corpusmill:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """(page_id, url, html, n, digest, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    # SHA-256 tells payloads apart; equal ones are counted without their bytes
    large = rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy(F.sha2("html", 256).alias("same")).agg(F.max("page_id").alias("first"), F.count("*").alias("c"))
    again = materialize(large.where("c > 1").drop("c"))
    marked = rows.withColumn("same", F.when(F.col("n") >= least, F.sha2("html", 256))).join(again, "same", "left")
    return marked.withColumn("refers_to", F.when(F.col("first") > F.col("page_id"), F.col("first"))).drop("same", "first")


def _uri(url: Column, page_id: Column) -> Column:
    """Header values hold no white space or control characters."""
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit(RECORD_ID), page_id))


def record(rows: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the text of a record without its final two line ends."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    page_id = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    rows = rows.withColumn("block", F.when(revisit, http).otherwise(F.concat(http, "html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit(f"<{RECORD_ID}"), page_id, F.lit(">")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"), page_id)),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.lit(f"<{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(""),
        line("WARC-Block-Digest", F.lit("sha1:"), F.sha1(F.col("block").cast("binary"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, "block").alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Archives (page_id, url, html) as plain WARC files in ``folder``."""
    length = F.octet_length("html")
    n, size, longest = pages.agg(F.count("*"), F.sum(length), F.max(length)).first()
    usual = max(1, LONG * (size or 0) // max(1, n))
    rows = roles(pages)

    def save(some: DataFrame, each: int, mode: str) -> None:
        record(some).write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", max(1, FILE_BYTES // each)).text(folder)

    if (longest or 0) <= usual:
        return save(rows, max(1, (size or 0) // max(1, n)), "overwrite")
    # pages of many times the mean length have files of their own, so that no file grows far beyond its size
    save(rows.where(F.col("n") <= usual), max(1, usual // LONG), "overwrite")
    save(rows.where(F.col("n") > usual), longest, "append")


# ---------------------------------------------------------------- reader

_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_START = re.compile(rb"WARC/1\.\d\r\n|\x1f\x8b\x08")


class Damaged(ValueError):
    """A check failed."""


def holds(data: bytes, digest: str | None) -> bool | None:
    """Whether a SHA-1 digest, in hexadecimal or base 32, is that of the data; None for other digests and without one."""
    kind, _, want = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(want) if len(want) == 40 else base64.b32decode(want.upper())
    except ValueError:
        return None
    return hashlib.sha1(data).digest() == raw if len(raw) == 20 else None


def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, block) of the record at ``at``."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    name, at = "", m.end()
    while True:
        after = data.find(b"\r\n", at)
        if after < 0:
            raise Damaged("headers do not end")
        line, at = data[at:after], after + 2
        if not line:
            break
        if name and line[:1] in (b" ", b"\t"):  # a folded line
            headers[name] = f"{headers[name]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        name = key.strip().lower().decode("utf-8", "replace")
        headers[name] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    start, end = at, at + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it says")
    block = data[start:end]
    if holds(block, headers.get("warc-block-digest")) is False:
        raise Damaged("block digest differs")
    return end + 4, headers, block


def _member(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """As _plain, for a gzip member that holds one record."""
    unzip, parts, step, view = zlib.decompressobj(31), [], 4096, memoryview(data)
    while not unzip.eof:
        if at >= len(data):
            raise Damaged("gzip member does not end")
        # a member leaves its last step's rest behind, so steps begin small
        try:
            parts.append(unzip.decompress(view[at : at + step]))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at, step = min(at + step, len(data)), min(2 * step, 1 << 20)
    raw = b"".join(parts)
    end, headers, block = _plain(raw, 0)
    if end != len(raw):
        raise Damaged("gzip member holds more than a record")
    return at - len(unzip.unused_data), headers, block


def records(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict[str, str], bytes]]:
    """("record", start, end, None, headers, block) and ("gap", start, end, reason, {}, b"") in the order of the file."""
    at = bad = 0
    reason = None
    while at < len(data):
        try:
            end, headers, block = (_member if data[at : at + 2] == b"\x1f\x8b" else _plain)(data, at)
        except Damaged as e:
            if reason is None:
                bad, reason = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if reason is not None:
            yield "gap", bad, at, reason, {}, b""
            reason = None
        yield "record", at, end, None, headers, block
        at = end
    if reason is not None:
        yield "gap", bad, len(data), reason, {}, b""


SCHEMA = "path string, kind string, start long, end long, reason string, headers map<string,string>, payload binary, payload_bytes long, payload_holds boolean"
_ARROW = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
     ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_holds", pa.bool_())]
)
#: Payload bytes in one batch that a task gives back.
BATCH_BYTES = 8 << 20


def _http(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """(payload, its length as the HTTP headers say, which a revisit keeps without the payload)."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
    return payload, int(said[1]) if said else len(payload)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record and for each gap of all files in ``folder``; payload_holds: whether the payload has the digest
    that its record states, null where it states none. A file is one row of Spark's reader, so it has less than 2 GB."""

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for kind, start, end, reason, headers, block in records(content.as_py()):
                    payload, size = _http(headers, block) if kind == "record" else (None, None)
                    whole = holds(payload, headers.get("warc-payload-digest")) if kind == "record" and headers.get("warc-type") != "revisit" else None
                    rows.append((path.as_py(), kind, start, end, reason, list(headers.items()), payload, size, whole))
                    held += end - start
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives the pages and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark)
    write(pages, folder)
    page = lambda name: F.regexp_extract(F.element_at("headers", name), r"page:(-?[0-9]+)>", 1).try_cast("long")
    revisit = F.element_at("headers", "warc-type") == "revisit"
    said = F.substring(F.element_at("headers", "warc-payload-digest"), 6, 40)
    return read(spark, folder).where("kind = 'record'").select(
        page("warc-record-id").alias("page_id"),
        "payload_bytes",
        F.when(revisit, said).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.element_at("headers", "warc-type").alias("record_type"),
        F.when(revisit, page("warc-refers-to")).alias("refers_to"),
    )
