"""WARC archives: written by Spark, read back, and assembled into one nested row per capture."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Frames, shared_path

CRLF = "\r\n"
# Payloads of fewer bytes are never stored as revisits.
LEAST_REVISIT = 100
# All captures carry one date: the tables have none.
DATE = "2024-01-01T00:00:00Z"
# Payload bytes of the pages that share an archive file, pages up to a size at a time: (largest payload, pages of
# a file). A larger payload has a file of its own. Bytes that are unpacked at a time.
FILE_PAGES = ((16 << 10, 2000), (1 << 20, 32))
CHUNK = 1 << 20
# Repeats of one row that a task writes.
REPEATS = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, page: Column, url: Column, digest: Column, number: Column) -> Column:
    """An identifier made from what a row holds and its number among the rows that are equal to it."""
    x = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), url, digest, number.cast("string")))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line breaks that end it; header values that are null are left out."""
    size = ("Content-Length", F.octet_length(block).cast("string"))
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in [*headers, size]]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def stored_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) without nulls in url and html."""
    # a line break in a URL would end the header
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    return pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, bytes, copies) of the different rows of ``pages``."""
    narrow = pages.select("page_id", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    return narrow.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))


def first_captures(facts: DataFrame) -> DataFrame:
    """(digest, first_id, first_page, first_url) of payloads that several pages have and that are long enough."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first")
    shared = facts.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("pages"), first).where("pages > 1")
    return shared.select(F.col("digest").alias("first_digest"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))


def numbered(pages: DataFrame, facts: DataFrame, every_row: bool) -> DataFrame:
    """``pages`` with ``digest`` and ``number``: 1, 2, ... for the rows that are equal, or 1 and each of them once.

    Rows that repeat are taken once and written out by their number, in parts of ``REPEATS``.
    """
    row = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "digest"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("row", row)
    repeated = facts.where("copies > 1").select(row.alias("row"), "copies")
    single = pages.join(repeated, "row", "left_anti").withColumn("number", F.lit(1).cast("long"))
    once = pages.join(repeated, "row", "left_semi").groupBy("row").agg(*(F.first(k).alias(k) for k in ("page_id", "url", "html", "digest")))
    last = F.col("copies") if every_row else F.lit(1).cast("long")
    parts = repeated.select("row", last.alias("last"), F.explode(F.sequence(F.lit(1).cast("long"), last, F.lit(REPEATS).cast("long"))).alias("begin"))
    many = parts.join(once, "row").withColumn("number", F.explode(F.sequence("begin", F.least("last", F.col("begin") + REPEATS - 1))))
    columns = ("page_id", "url", "html", "digest", "number")
    return single.select(*columns).union(many.select(*columns))


def archive_records(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """(value) one row per record: a response or revisit, a request and a metadata record for each numbered page."""
    x = pages.join(shared, F.col("digest") == F.col("first_digest"), "left")
    c = F.col
    again = c("first_digest").isNotNull() & ~c("page_id").eqNullSafe(c("first_page"))
    own = record_id("response", c("page_id"), c("url"), c("digest"), c("number"))
    origin = F.when(again, record_id("response", c("first_page"), c("first_url"), c("digest"), F.lit(1)))
    target = ("WARC-Target-URI", F.when(c("url") == "", F.lit("urn:no-url")).otherwise(c("url")))
    date = ("WARC-Date", F.lit(DATE))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    capture = record(
        [
            ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", own),
            date,
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("digest"))),
            ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", origin),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, http).otherwise(F.concat(http, c("html"))),
    )
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")
    path = F.when(F.substring(path, 1, 1) == "/", path).otherwise(F.concat(F.lit("/"), path))
    request = record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", c("page_id"), c("url"), c("digest"), c("number"))), date, target, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
    )
    page = F.when(c("page_id").isNotNull(), F.concat(F.lit("page-id: "), c("page_id").cast("string"), F.lit(CRLF)))
    metadata = record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", c("page_id"), c("url"), c("digest"), c("number"))), date, target, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(page, F.lit("")), F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit(CRLF)),
    )
    return x.select(F.explode(F.array(capture, request, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, frames: Frames, every_row: bool = False) -> None:
    """Compressed archives under ``path``, in the shared store, through Spark's own writer.

    Every record ends with the two line breaks that the format asks for, so that a file's records
    in a row are an archive. Pages of like size are written together, so that files are bounded in
    bytes: a reader takes up a file at a time. A page's three records may lie in different files.
    """
    pages = stored_pages(pages)
    facts = frames.keep(page_facts(pages))
    shared = frames.keep(first_captures(facts))
    above = -1
    for most, number in (*FILE_PAGES, (None, 1)):
        held = (F.col("bytes") > above) if most is None else (F.col("bytes") > above) & (F.col("bytes") <= most)
        mine = facts.where(held)
        # an empty table still has its folder
        if above == -1 or mine.limit(1).count():
            some = numbered(pages.withColumn("bytes", F.octet_length("html")).where(held), mine, every_row)
            writer = archive_records(some, shared).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * number)
            writer.text(f"{path}/{'larger' if most is None else f'to-{most}'}")
        above = most


def unpacked(content: bytes) -> Iterator[bytes]:
    """The plain bytes of a file of one or more gzip members, a chunk at a time; plain files as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest, machine = memoryview(content), zlib.decompressobj(31)
    at = 0
    while at < len(rest):
        yield machine.decompress(rest[at : at + CHUNK])
        at += CHUNK
        while machine.eof and (left := machine.unused_data):
            machine = zlib.decompressobj(31)
            yield machine.decompress(left)
        if machine.eof:
            machine = zlib.decompressobj(31)
    yield machine.flush() if not machine.eof else b""


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record. Lengths alone say where a block ends, whatever it holds."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            more = next(chunks, None)
            if more is None:
                ended = True
            else:
                held.extend(more)
        return len(held) >= n

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        if end < 0:
            return
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(bytes(held[:end]))}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("the archive ends within a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


RECORDS = "capture string, kind string, id string, url string, digest string, refers_to string, payload binary, payload_digest string, fields map<string,string>"


def read_records(archives: DataFrame) -> DataFrame:
    """The records of archive files (``path``, ``content``): of which capture, of what kind, and what they hold."""

    fields_of = T.StructType.fromDDL(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(fields_of)
        for batch in batches:
            for file in batch.column(0):
                rows, held = [], 0
                for headers, block in parsed(unpacked(file.as_py())):
                    kind, own = headers["warc-type"], headers["warc-record-id"]
                    payload, digest, fields = None, None, None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = hashlib.sha256(payload).hexdigest()
                    elif kind == "metadata":
                        fields = [(k.decode(), v.decode()) for k, v in HEADER.findall(block)]
                    elif kind == "request":
                        fields = [("line", block.split(b"\r\n", 1)[0].decode())]
                    rows.append((headers.get("warc-concurrent-to", own), kind, own, headers.get("warc-target-uri"), headers.get("warc-payload-digest"), headers.get("warc-refers-to"), payload, digest, fields))
                    held += len(block)
                    if held > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("content").mapInArrow(run, fields_of)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with request and metadata records.

    Records meet by the identifier of the capture: their own for responses and revisits, the one
    that WARC-Concurrent-To names for the others. Records repeated in archives count once.
    """
    of = lambda kinds, *columns: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*columns)))
    return records.groupBy("capture").agg(
        of(("response", "revisit"), "kind", "id", "url", "digest", "refers_to", "payload_digest", "payload").alias("response"),
        of(("request",), "id", F.col("fields")["line"].alias("line")).alias("request"),
        of(("metadata",), "id", F.col("fields")["page-id"].alias("page_id"), F.col("fields")["payload-bytes"].cast("long").alias("payload_bytes")).alias("metadata"),
    )


def read_archives(spark, path: str) -> DataFrame:
    """Captures of all archive files under ``path``."""
    return assemble(read_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)))


def archive_pages(pages: DataFrame, every_row: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives and gives the captures read back from them.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes those with the smallest page_id
    are stored as response, the others as revisits of the first of these.

    Null html is an empty payload, null urls are stored as ``urn:no-url``, a null page_id is left out
    of the metadata and is never the smallest. Rows that are equal in all three columns are one
    capture, or with ``every_row`` a capture each. An empty table gives no captures; other columns are not looked at.
    """
    spark = pages.sparkSession
    frames = Frames(spark)
    path = shared_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, frames, every_row)
    frames.release()
    return read_archives(spark, path)


def page_digest(captures: DataFrame, page_type: str = "bigint") -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id)."""
    narrow = captures.select(
        F.col("capture"),
        F.col("metadata.page_id").cast(page_type).alias("page_id"),
        F.coalesce(F.octet_length("response.payload").cast("long"), F.col("metadata.payload_bytes")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", F.regexp_replace("response.digest", "^sha256:", "")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )
    frames = Frames(captures.sparkSession)
    narrow = frames.keep(narrow)
    targets = narrow.join(narrow.where("refers_to is not null").select(F.col("refers_to").alias("capture")).distinct(), "capture", "left_semi").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("target"))
    return narrow.join(targets, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("target").alias("refers_to"))
