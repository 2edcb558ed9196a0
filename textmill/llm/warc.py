"""WARC archives: writing captures, and assembling transactions from records.

A capture is a request, a response (or a revisit of an earlier response with the same payload) and a metadata record that
name the response in WARC-Concurrent-To. Archives are written by Spark's text sink with CRLF CRLF between records, which is
how the format ends a record, so they lie wherever Spark can write. Reading streams the files of a folder, in parts between
CRLF CRLF from which records are put together by their Content-Length, and joins these through the concurrent-to identifiers
into one nested row for each capture.

Which record of a payload is the response is found by an aggregate over digests and a join with those of several captures
only; both sides are plain tables, so that adaptive execution splits a hot digest. A revisit names its response's record id,
and the id holds the page id, so that nothing need be joined with a hot response.

Defined results: a null payload is empty; rows that are equal in page id, url and payload are captures of their own, by an
occurrence number in their record ids; a null page id is kept and comes back null; of equal payloads none with a null page id is the response unless all are; a null url is written as
an empty target. An empty table gives no rows. Payloads and headers of any length are read whole; a file holds at most
``per_file`` records, and is never held whole. Malformed or cut-off records are rows with an error, in no capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import cut, shared_dir

CRLF = "\r\n"
RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, "
    "date string, content_type string, http_length long, payload binary, fields map<string,string>, error string"
)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: int, page_id: Column, rest: Column) -> Column:
    """<urn:uuid:..>: 8 hex digits of ``rest`` (with the kind in the first), a fixed part, and the page id's 16 in the order of the format."""
    h = F.lpad(F.hex(rest), 16, "0")
    p = F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0")
    null = F.when(page_id.isNull(), F.lit("f")).otherwise(F.lit("0"))
    text = F.concat(F.lit(str(kind)), null, F.substring(h, 1, 6), F.lit("-"), F.substring(h, 7, 4), F.lit("-"), F.substring(h, 11, 4), F.lit("-"), F.substring(p, 1, 4), F.lit("-"), F.substring(p, 5, 12))
    return F.lower(F.concat(F.lit("<urn:uuid:"), text, F.lit(">")))


def page_of(rid: str | None) -> int | None:
    """The page id in a record id of ours."""
    m = re.fullmatch(r"<urn:uuid:[0-9a-f]([0-9a-f])[0-9a-f]{6}-[0-9a-f]{4}-[0-9a-f]{4}-([0-9a-f]{4})-([0-9a-f]{12})>", rid or "")
    if not m or m[1] == "f":
        return None
    n = int(m[2] + m[3], 16)
    return n - (1 << 64) if n >= 1 << 63 else n


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload`` with digest, size, rest (a hash), kind (response or revisit) and first (page id of the response). Payloads of fewer than
    ``least`` bytes are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    rest = F.xxhash64("page_id", "url", "digest")
    # repeated ids are few: their rows are cut, so that a row has the same occurrence number wherever it is read
    twice = cut(rows.groupBy("page_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("page_id").alias("i")), "repeated")
    if twice.isEmpty():
        rows = rows.withColumn("rest", rest)
    else:
        again = F.col("page_id").eqNullSafe(F.col("i"))
        some = cut(rows.join(twice, again, "left_semi").withColumn("o", F.monotonically_increasing_id()), "repeated")
        first = cut(some.groupBy(rest.alias("r")).agg(F.min("o").alias("o")), "first")
        some = some.join(first.select(F.col("o").alias("f")), F.col("o") == F.col("f"), "left").withColumn("rest", F.when(F.col("f").isNotNull(), rest).otherwise(F.xxhash64("page_id", "url", "digest", "o")))
        rows = rows.join(twice, again, "left_anti").withColumn("rest", rest).unionByName(some.drop("o", "f"))
    key = F.struct("page_id", "rest")
    many = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max(key).alias("top"), F.min(key).alias("low")).filter("not (top <=> low)").select("digest", "top")
    both = rows.join(cut(many, "copies"), "digest", "left")
    again = F.col("top").isNotNull() & ~key.eqNullSafe(F.col("top")) & (F.col("size") >= least)
    return both.withColumn("kind", F.when(again, "revisit").otherwise("response"))


def head(kind: str, rid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end. Fields that are null are left out."""
    lines = [F.lit("WARC/1.1" + CRLF + "WARC-Type: " + kind if kind else "")]
    lines += [F.coalesce(F.concat(F.lit(f"{CRLF}{k}: "), v), F.lit("")) for k, v in [("WARC-Record-ID", rid), *fields]]
    lines.append(F.concat(F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2)))
    return F.concat(*[c.cast("binary") for c in lines], block)


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = 20_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""
    d = decide(pages, least)
    clean = F.regexp_replace("url", r"[\r\n]", "")
    resp, req, meta = (record_id(k, F.col("page_id"), F.col("rest")) for k in (1, 2, 3))
    when = ("WARC-Date", F.lit(date))
    uri = ("WARC-Target-URI", clean)
    again = F.col("kind") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2)).cast("binary")
    answer = head("", resp, [
        when, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Refers-To", F.when(again, record_id(1, F.col("top.page_id"), F.col("top.rest")))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
    ], F.when(again, http).otherwise(F.concat(http, F.col("payload"))))
    answer = F.concat(F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("kind")).cast("binary"), answer)
    asked = head("request", req, [when, uri, ("WARC-Concurrent-To", resp), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), clean, F.lit(f" HTTP/1.1{CRLF}{CRLF}")).cast("binary"))
    told = head("metadata", meta, [when, uri, ("WARC-Concurrent-To", resp), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)).cast("binary"))
    records = d.select(F.explode(F.array(asked, answer, told)).alias("r")).select(F.col("r").cast("string").alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def record_of(fields: dict[str, str], block: bytes, error: str | None = None) -> dict:
    """A row of ``RECORD``."""
    kind, typ = fields.get("warc-type", ""), fields.get("content-type", "")
    payload, length = block, None
    if typ.startswith("application/http"):
        top, sep, body = block.partition(b"\r\n\r\n")
        payload = body if sep else b""
        m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", top)
        length = int(m[1]) if m else None
    info = {}
    if kind == "metadata" and "warc-fields" in typ:
        for line in block.decode("utf-8", "replace").split(CRLF):
            k, sep, v = line.partition(":")
            if sep:
                info[k.strip()] = v.strip()
    return {
        "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest"), "date": fields.get("warc-date"), "content_type": fields.get("content-type"), "http_length": length, "payload": payload, "fields": info, "error": error,
    }


def records(parts: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
    """The records of archives from their parts between CRLF CRLF, each with its file's number. What is no record, or one whose block does not end where its
    Content-Length says, becomes a row with an error; reading goes on at the next part that begins a record."""
    end = b"\r\n\r\n"
    fields: dict[str, str] | None = None
    pending: list[bytes] = []
    size = want = 0
    file = None
    for f, part in chain(parts, [(None, b"")]):
        if f != file:
            if fields is not None:
                yield record_of(fields, b"".join(pending).removesuffix(end), "cut off")
            fields, pending, size, file = None, [], 0, f
        pending += [part, end]
        size += len(part) + 4
        while True:
            if fields is None:
                head, sep, rest = b"".join(pending).lstrip(b"\r\n").partition(end)
                if not sep:
                    pending, size = [head], len(head)
                    break
                pending, size = [rest], len(rest)
                if not head.startswith(b"WARC/"):
                    yield record_of({}, head, "no record")
                    continue
                fields = fields_of(head)
                n = fields.get("content-length", "")
                if not (n.isascii() and n.isdigit()):
                    yield record_of(fields, b"", "no valid Content-Length")
                    fields = None
                    continue
                want = int(n)
            if size < want + 4:
                break
            data = b"".join(pending)
            whole = data.startswith(end, want)
            yield record_of(fields, data[:want], None if whole else "longer than Content-Length")
            rest = data[want + 4 :] if whole else data[want:]
            fields, pending, size = None, [rest], len(rest)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``, gzipped or not, read as streams: a task holds no more than a batch of parts and one record."""

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", RECORD).split(",")]
        some, n = [], 0
        for r in records((f, bytes(x)) for p in it for f, x in zip(p["file"].tolist(), p["part"])):
            some.append(r)
            n += len(r["payload"])
            if n > 4_000_000 or len(some) >= 2000:
                yield pd.DataFrame(some, columns=cols).astype({"http_length": "Int64"})
                some, n = [], 0
        if some:
            yield pd.DataFrame(some, columns=cols).astype({"http_length": "Int64"})

    parts = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    return parts.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part")).mapInPandas(of, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """Of the records without an error one row for each response or revisit: capture_id, the record's own columns, and request and metadata as structs (null where there is none)."""
    records = records.filter("error is null")
    main = records.filter("type in ('response', 'revisit')").withColumnRenamed("record_id", "capture_id").drop("concurrent_to", "fields", "error")
    side = lambda kind, name: (
        records.filter(F.col("type") == kind).filter("concurrent_to is not null")
        .select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "date", "target_uri", "payload", "fields").alias(name))
    )
    # a metadata record may name the request instead of the response
    asked = side("request", "request")
    told = side("metadata", "metadata")
    via = told.alias("t").join(asked.select(F.col("request.record_id").alias("rid"), F.col("capture_id").alias("cid")), F.col("t.capture_id") == F.col("rid"), "left").select(F.coalesce("cid", "t.capture_id").alias("capture_id"), "metadata")
    one = lambda df, name: df.groupBy("capture_id").agg(F.min_by(name, F.col(f"{name}.record_id")).alias(name))
    return main.dropDuplicates(["capture_id"]).join(one(asked, "request"), "capture_id", "left").join(one(via, "metadata"), "capture_id", "left")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble the captures; per capture also page_id, payload_bytes,
    payload_digest (of the full payload: of a response computed, of a revisit as its record says), record_type and refers_to (a page id)."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/textmill/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    rows = assemble(read(spark, path))

    @F.pandas_udf("long")
    def page(rid: pd.Series) -> pd.Series:
        return pd.Series([page_of(r) for r in rid], dtype="Int64")

    own = F.col("type") == "response"
    return rows.select(
        page("capture_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(own, digest(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~own, page("refers_to")).alias("refers_to"),
        "capture_id", "target_uri", "date", "request", "metadata", "payload",
    )


def sha1_base32(payload: bytes) -> str:
    """What ``digest`` gives, in Python."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
