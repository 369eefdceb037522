"""WARC archives with revisit records (ISO 28500)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, keep, table, work_path

CRLF = "\r\n"
#: Payload bytes of an archive, about; a file is read back by one task.
ARCHIVE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id string, url string, record_type string, record_id string, refers_record string, payload_digest string, payload_bytes long, digest_ok boolean"
DIGEST = ["sha1", "payload_bytes"]


def resolve(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page's header row: its digest, size, and the page that holds the response.

    Of equal payloads of at least min_bytes bytes the largest key is the response; smaller ones are all responses.  A
    null key is less than any other: its page revisits the largest, and is a response where all are null.  Headers alone
    move: they are summed up by digest, and then meet the response of their digest, those of payloads that very many
    pages share by broadcast.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    size, sha1 = F.octet_length(body).cast("long").alias("payload_bytes"), F.unhex(F.sha1(body)).alias("sha1")
    heads = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), size, sha1)
    first = heads.groupBy(*DIGEST).agg(F.max("page_id").alias("original_id"), F.count("*").alias("_pages"))
    out = join_counted(heads, keep(first, "payloads"), DIGEST, "_pages").drop("_pages")
    again = (F.col("payload_bytes") >= min_bytes) & ~F.col("original_id").eqNullSafe(F.col("page_id"))
    return out.withColumn("refers_to", F.when(again, F.col("original_id")))


def record_id(page: str | None, sha1: bytes) -> str:
    """A record's name: made from the page's, or for a page without one from its payload, so a task that runs again writes the same."""
    h = hashlib.sha256(f"record {page}".encode() if page is not None else b"payload " + sha1).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _clean(text: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", text) if isinstance(text, str) and text else "urn:unknown"


def _quoted(page: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() or c in "-_.~" else "".join(f"%{b:02X}" for b in c.encode()) for c in page)


def _unquoted(page: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), page.encode()).decode()


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, without its last byte, which is 0.

    A member ends with the length of what it holds, low byte first; that of 16 MB or more is followed by an empty
    member, so that the last byte is always the one that the sink writes behind every row.
    """
    data = gzip.compress(record, 6, mtime=0)
    if data[-1]:
        data += gzip.compress(b"", mtime=0)
    return data[:-1]


def _record(head: list[str], block: bytes) -> bytes:
    return member(CRLF.join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")


def _render(date: str):
    """Members of an archive: a warcinfo record, then a record for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, held, size = False, [], 0
        for b in batches:
            for page, url, html, sha1, revisit, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = record_id(page, sha1)
                if not begun:
                    begun = True
                    note = f"software: vaneflow{CRLF}format: WARC File Format 1.1{CRLF}".encode()
                    info = record_id(f"warcinfo {name}", sha1)
                    held.append(_record(["WARC-Type: warcinfo", f"WARC-Record-ID: {info}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], note))
                payload = (html or "").encode()
                http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                block = f"{http}{CRLF}".encode() if revisit else f"{http}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
                head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
                head += [f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
                head += ["Content-Type: application/http; msgtype=response"]
                if page is not None:
                    head.append(f"X-Page-ID: {_quoted(page)}")
                if revisit:
                    head += [f"WARC-Refers-To: {record_id(refers, sha1)}", f"WARC-Profile: {PROFILE}"]
                held.append(_record(head, block))
                size += len(held[-1])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write a record for every page (page_id, url, html) into archives of about ARCHIVE_BYTES of payload each.

    Each archive begins with a warcinfo record, and each record is a gzip member of its own, so that readers can start
    at any.  Null html is an empty payload; a null or odd url becomes a legal target; a null page_id is left out of the
    header.  Ids may be of any type, and should be unique: rows that repeat an id with the same payload give equal
    records.  Other columns play no part; an empty table gives no archives.  A payload must fit a row (2 GB).  Spark's
    text sink writes and commits the files, so a lost executor leaves no half archive.
    """
    heads = resolve(pages, min_bytes).select("page_id", "sha1", "refers_to", F.col("refers_to").isNotNull().alias("revisit")).distinct()
    heads = heads.withColumnsRenamed({"page_id": "_page", "sha1": "_sha1"})
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    sha1 = F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    rows = pages.select("page_id", "url", "html", sha1.alias("sha1"))
    # dealt once, by page and payload: the join's partitions are the archives
    n = 1 + total // ARCHIVE_BYTES
    named = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = rows.withColumn("_k", named("page_id")).repartition(n, "_k", "sha1")
    heads = heads.withColumn("_h", named("_page")).repartition(n, "_h", "_sha1")
    same = (F.col("_k") == F.col("_h")) & (F.col("sha1") == F.col("_sha1"))
    whole = F.when(~F.col("revisit"), F.col("html")).alias("html")
    out = rows.join(heads, same).select(F.col("page_id").cast("string").alias("page_id"), "url", whole, "sha1", "revisit", F.col("refers_to").cast("string").alias("refers_to"))
    # as bytes: a string column would do, but has to be valid text on its way from Python
    members = out.mapInArrow(_render(date), "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)


def _members(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, member by member: what the headers say, and the block."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], 1 << 16
        while not z.eof and at < len(view):
            parts.append(z.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(z.unused_data)
        record = b"".join(parts)
        if record:
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in READ.split(", ")]
    for b in batches:
        for content in b.column(0).to_pylist():
            rows = []
            for head, block in _members(content or b""):
                if head["WARC-Type"] == "warcinfo":
                    continue
                whole, payload = head["WARC-Type"] == "response", block.partition(b"\r\n\r\n")[2]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else digest
                page = _unquoted(head["X-Page-ID"]) if "X-Page-ID" in head else None
                rows.append((page, head["WARC-Target-URI"], head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), own, len(payload) if whole else None, own == digest))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def read_archives(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Every record of the archives but warcinfo, revisits joined to the responses that they name.

    page_id (as key_type), payload_bytes and payload_digest (of the full payload), record_type, refers_to, url,
    digest_ok (the payload has the digest that its header states).  A revisit whose response isn't in these archives has
    null payload_bytes.  The archives are read once; responses don't take part in the join.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = keep(files.mapInArrow(_read, READ), "warc-records").withColumn("page_id", F.col("page_id").cast(key_type))
    whole = records.filter("record_type = 'response'").drop("refers_record")
    again = records.filter("record_type = 'revisit'").drop("payload_bytes", "record_id")
    named = again.groupBy("refers_record").count()
    full = whole.select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), "payload_bytes").dropDuplicates(["refers_record"])
    full = keep(named.join(full, "refers_record"), "warc-responses")
    found = join_counted(again, full, ["refers_record"], "count", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok"]
    none = whole.withColumn("refers_to", F.lit(None).cast(key_type))
    return none.select(*out).unionByName(found.select(*out))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(s, CAST(i // 4 * 5 AS INT) + 1, 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, TRUE AS digest_ok
FROM d
"""
