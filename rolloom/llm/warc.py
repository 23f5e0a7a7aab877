"""WARC archives with resolved revisits.

1. Headers only (no payloads) are shuffled by payload digest; the first page of a
   digest is its original, and only digests that occur twice or more go on. These are
   broadcast where they are few; where they are many, those of hot digests still are
   (``columns.meet``), so a digest of very many pages (such as the empty page) is no
   task's burden.
2. Pages meet their decision by row number and become records: a response with
   its payload, or a revisit with a fresh header that names the original. The number
   of archives follows from the bytes that they hold.
3. Spark's text writer puts the records into archives: the separator between two
   text rows is the CRLF CRLF that ends a WARC record, so every part file is a
   sequence of valid records, on any file system Spark can write.
4. The archives are read back, parsed by Content-Length as they are decompressed, and
   revisits are joined to their originals by record id for what their headers leave
   out. Digests and sizes of responses are worked out again from the payload that was
   read; a header that disagrees is an error.

An archive is one gzip member, since Spark's writers give no others: a reader cannot
begin in its middle, so archives are kept to about ``ARCHIVE_BYTES``.

Originals: of pages with equal payloads of at least ``min_bytes`` bytes, the one
with the smallest id (null ids last; of repeated rows, the first by row number).
Defined results: a null html is an empty payload; very long payloads are one record
each; a null url gives no WARC-Target-URI; control characters and blanks in a url are
percent-encoded, so that no header can be injected; repeated rows give a record each;
an empty table gives an empty archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.columns import meet
from rolloom.session import materialize, prepare

#: The alphabets of conv(…, 32) and of base32 (RFC 4648).
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, payload string"
#: Bytes of payload that an archive is meant to hold, and its rows at most.
ARCHIVE_BYTES, ARCHIVE_ROWS = 16 << 20, 100_000
#: Bytes read and passed on at once.
BLOCK = 4 << 20


def payload_digest(payload: Column) -> Column:
    """SHA-1 of the UTF-8 text in upper-case base32, by groups of 20 bits."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def headers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest and the row number of every page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"),
        payload_digest(html).alias("payload_digest"), F.monotonically_increasing_id().alias("rid"),
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and the original's page id and row number, null for responses."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid"))
    copied = (
        heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    )
    again = F.col("first_rid").isNotNull() & (F.col("rid") != F.col("first_rid")) & (F.col("payload_bytes") >= min_bytes)
    return meet(heads, copied, ["payload_digest"], how="left").select(
        "page_id", "rid", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_rid")).alias("first_rid"),
    )


def _record_id(digest: Column, rid: Column) -> Column:
    """A name-based id in the layout of a UUID."""
    h = F.md5(F.concat_ws(":", digest, rid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _safe_url(url: Column) -> Column:
    """Control characters and blanks percent-encoded."""
    safe = url
    for code in (*range(33), 127):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(url)


def records(pages: DataFrame, resolved: DataFrame, date: str, n_archives: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The text of one WARC/1.1 record per page, without the blank lines that end it."""
    source = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = resolved.select("rid", "page_id", "payload_bytes", "payload_digest", "record_type", "first_rid")
    if n_archives is not None:  # the join takes over this partitioning
        source, d = source.repartition(n_archives, "rid"), d.repartition(n_archives, "rid")
    rows = source.join(d.hint("merge"), "rid")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("payload_digest"), F.col("rid"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _safe_url(F.col("url")))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("payload_digest"), F.col("first_rid"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.when(revisit, F.lit("")).otherwise(F.lit("Content-Type: application/http; msgtype=response\r\n")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes deduplicated, gzipped archives of all pages into the folder ``path``."""
    heads = materialize(headers(pages, id_col, html_col))
    n_archives = max(1, -(-(heads.agg(F.sum("payload_bytes")).first()[0] or 0) // ARCHIVE_BYTES))
    out = records(pages, materialize(resolve(heads, min_bytes)), date, n_archives, id_col, url_col, html_col)
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_ROWS).mode("overwrite").text(path)


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of an archive, whose bytes come in chunks."""
    source, held = iter(chunks), bytearray()

    def more() -> bool:
        chunk = next(source, None)
        if chunk is not None:
            held.extend(chunk)
        return chunk is not None

    while held or more():
        end = held.find(END.encode())
        while end < 0 and more():
            end = held.find(END.encode())
        version, *lines = bytes(held[: max(end, 0)]).decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", version):
            raise ValueError("no WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(head["Content-Length"])
        while len(held) < stop + 4 and more():
            pass
        if len(held) < stop:
            raise ValueError("a WARC record is cut off")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _inflated(data: bytes) -> Iterator[bytes]:
    """The contents of a file of gzip members, a bounded piece at a time."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(data, BLOCK)
            data = member.unconsumed_tail
            if not out and not data and not member.eof:
                raise ValueError("a gzip member is cut off")
            if out:
                yield out
        data = member.unused_data


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in RECORD.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in parse(_inflated(content.as_py())):
                digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Page-Id")
                payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} is not that of its header")
                rows.append((
                    None if page is None else int(page), head["WARC-Record-ID"], head["WARC-Type"], digest,
                    None if payload is None else len(payload), head.get("WARC-Refers-To"), None if payload is None else payload.decode(),
                ))
                size += len(block)
                if size > BLOCK:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_id, record_type, payload_digest, payload_bytes, refers_to_id, payload."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed, RECORD)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, with revisits resolved."""
    heads = materialize(read_archives(spark, path).drop("payload"))
    again = heads.where("record_type = 'revisit'").drop("payload_bytes")
    # Only originals that are referred to; one with very many revisits is dealt out.
    used = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes"))
    used = used.join(again.select("refers_to_id").distinct(), "refers_to_id", "left_semi")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = meet(again, used, ["refers_to_id"], how="left").select(names)
    return heads.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(revisits)


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes archives and reads them back. path: a shared folder; by default a new one under the checkpoint folder."""
    spark = prepare(pages.sparkSession)
    if path is None:
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_resolved(spark, path)
