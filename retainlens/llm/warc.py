"""WARC writing, and reading with boundary-chain verification (operator 3).

Writing: each page becomes one WARC/1.1 record through Spark's text writer (record separator
CRLF CRLF), so any store that Spark writes works. Of equal payloads (by SHA-1 and length) the
largest page_id is the ``response``; the others are ``revisit`` records without a body.

Reading: each task searches its files for the record magic anywhere and emits, per candidate, its
offset and the offset of its successor (from Content-Length). Magic inside payloads gives false
candidates. Pointer jumping over (file, offset) from each file's start, in Spark rounds, keeps
only the records that a chain of successors reaches. Files are read whole by one task each; the
writer starts a new file per input partition, so a file is about an input split.

Defined cases: null html is an empty payload; payloads below ``min_payload`` bytes are never
merged; repeated rows are separate records (of equal page_ids one is the response); rows with a
null page_id are written with the id "-" and read back as null, as are numbers that a foreign record lacks; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import column, cut

END = "\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Written for every record; capture times are not part of the pages table.
DATE = "1970-01-01T00:00:00Z"


def _base32(hexdigest):
    """Upper-case base32 of a 20-byte digest given in hex: 5 hex digits are 4 letters."""
    letters = []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(hexdigest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_ALPHABET), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def records(pages: DataFrame, min_payload: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One text row per page: the record without its closing separator."""
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                       F.coalesce(F.col(html), F.lit("")).alias("html"))
    src = src.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    # The largest page_id of each payload: partial maxima before the shuffle, and AQE splits a
    # payload that many pages share in the join.
    first = src.groupBy("sha", "size").agg(F.max("page_id").alias("top"))
    j = src.join(first, ["sha", "size"])
    revisit = (F.col("size") >= min_payload) & (F.col("page_id") < F.col("top"))
    uri = F.regexp_replace("url", r"[\s\x00-\x1f]", "%20")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("sha")),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("top").cast("string"),
                                 F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
        F.lit(END))
    return j.select(F.when(revisit, header).otherwise(F.concat(header, F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write the archives of ``pages`` to ``path`` (one file per partition; ``gzip`` or ``none``)."""
    records(pages, **options).write.mode("errorifexists").option("lineSep", END).option("compression", compression).text(path)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file (archives often hold one member a record); a cut member raises."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as members:
        return members.read()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("off", pa.int64()), ("succ", pa.int64()), ("size", pa.int64()), ("head", pa.string()),
                        ("body_bytes", pa.int64()), ("body_sha1", pa.string())])
    for batch in batches:
        for i in range(batch.num_rows):
            path, data = column(batch, "path")[i].as_py(), column(batch, "content")[i].as_py()
            if data[:2] == b"\x1f\x8b":
                data = _gunzip(data)
            rows = []
            for m in _MAGIC.finditer(data):
                end = data.find(b"\r\n\r\n", m.start())
                head = data[m.start():end] if 0 <= end else b""
                length = re.search(rb"\r\nContent-Length: *(\d{1,18})\r?$", head, re.M)
                if not length:
                    continue
                body = end + 4
                stop = body + int(length[1])
                if data[stop:stop + 4] != b"\r\n\r\n":
                    continue  # no record end there: not a record
                sha = base64.b32encode(hashlib.sha1(memoryview(data)[body:stop]).digest()).decode()
                rows.append((path, m.start(), stop + 4, len(data), head.decode("utf-8", "replace"), stop - body, sha))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the archives under ``path`` (any file not named _* or .*) that parses as a record, with its successor."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_candidates, "path string, off long, succ long, size long, head string, body_bytes long, body_sha1 string")


def reachable(links: DataFrame) -> DataFrame:
    """(path, off) of the records on the chain from offset 0, of links (path, off, succ).

    Pointer jumping: with J the jump of 2^k links, the reached set R grows to R + J(R) and J to
    J of J, until nothing new is reached: logarithmic rounds in the records of a file.
    """
    # Narrow keys: a hash of the file's name beside offsets.
    jump = cut(links.select(F.xxhash64("path").alias("f"), "off", "succ"))
    nodes = jump.select("f", "off")
    reached = nodes.filter(F.col("off") == 0)
    count, before = reached.count(), -1
    while count != before:
        step = jump.join(reached, ["f", "off"], "left_semi").select("f", F.col("succ").alias("off"))
        reached = cut(reached.union(step.join(nodes, ["f", "off"], "left_semi")).distinct())
        nxt = jump.select("f", F.col("off").alias("succ"), F.col("succ").alias("far"))
        jump = cut(jump.join(nxt, ["f", "succ"]).select("f", "off", F.col("far").alias("succ")))
        before, count = count, reached.count()
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """The verified records: page_id, record_type, refers_to, payload_digest, payload_bytes, body_bytes, body_sha1."""
    # Heads and digests wait in the shared folder: the archives are searched once.
    cand = cut(candidates(spark, path))
    real = cand.withColumn("f", F.xxhash64("path")).join(reachable(cand), ["f", "off"], "left_semi")
    field = lambda name, value="([^\\r\\n]*)": F.regexp_extract("head", rf"(?m)\r\n{name}: *{value}", 1)
    digit = lambda c: c.try_cast("long")
    return real.select(
        digit(field("WARC-Record-ID", r"<urn:page:(-?\d+)>")).alias("page_id"), field("WARC-Type").alias("record_type"),
        digit(field("WARC-Refers-To", r"<urn:page:(-?\d+)>")).alias("refers_to"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("payload_digest"),
        digit(field("X-Payload-Length", r"(\d+)")).alias("payload_bytes"), "body_bytes", "body_sha1")


def archive_and_read(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write the archives of ``pages`` below ``folder`` (default: the shared checkpoint folder), read
    them back and return one row per page. A response's digest and length come from its body."""
    spark = pages.sparkSession
    path = f"{(folder or ensure_checkpoint_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_payload=min_payload)
    got, response = read(spark, path), F.col("record_type") == "response"
    return got.select(
        "page_id", F.when(response, F.col("body_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("body_sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
        (~response | (F.col("body_sha1") == F.col("payload_digest"))).alias("digest_ok"))
