"""WARC: write captures as archives, read archives back, and assemble transactions through concurrent-to identifiers.

Archives are written and read by Spark alone, so any store works. A record ends with two line ends, which is the text
writer's line separator here; the reader goes by Content-Length.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

CRLF = "\r\n"
#: RFC 4648 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP_OK = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Payload bytes that the reader hands on at once.
BATCH_BYTES = 8 << 20
#: Payloads with copies that are spread to all tasks; with more of them pages are shuffled by payload digest.
MOST_SPREAD = 100_000

RECORDS = (
    "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, "
    "fields map<string,string>, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits in four groups of 40 bits, each eight digits to base 32."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * g, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def record_id(kind: str, *parts: Column) -> Column:
    """A urn that follows from what the record describes."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column, rid: Column, uri: Column, headers: list[Column], media: str, block: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), rid),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        *headers,
        F.lit(f"Content-Type: {media}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_captures(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_revisit_bytes: int = 0,
) -> None:
    """Write request, response or revisit, and metadata of every page as gzip archives below ``path``.

    Of pages with equal payloads of at least ``least_revisit_bytes`` bytes that with the largest id is the response and
    the others revisit it; rows that share the largest id are all responses. A null payload is empty, a null url is
    empty, and line ends in urls become spaces. Rows with a null id are responses of their own payload and have no
    page-id field. Rows equal in id, url and payload are written as often as they stand there, under one record id.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]+", " ").alias("uri"),
        payload.alias("p"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    copies = (
        base.filter(F.octet_length("p") >= least_revisit_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("id", "uri")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("__d"), "first")
    )
    copies = cut(copies)
    copies = F.broadcast(copies) if copies.count() <= MOST_SPREAD else copies
    base = base.join(copies, F.col("digest") == F.col("__d"), "left").withColumn("revisit", F.coalesce(F.col("id") < F.col("first.id"), F.lit(False)))
    me = record_id("capture", F.col("id"), F.col("digest"), F.col("uri"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), me)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), record_id("capture", F.col("first.id"), F.col("digest"), F.col("first.uri"))))
    profile = F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    get = F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit(""))
    records = F.array(
        _record(F.lit("request"), record_id("request", F.col("id"), F.col("digest"), F.col("uri")), F.col("uri"), [concurrent], "application/http; msgtype=request", get),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"), me, F.col("uri"), [digest, refers, profile],
            "application/http; msgtype=response", F.concat(F.lit(HTTP_OK), F.when(F.col("revisit"), "").otherwise(F.col("p"))),
        ),
        _record(F.lit("metadata"), record_id("metadata", F.col("id"), F.col("digest"), F.col("uri")), F.col("uri"), [concurrent], "application/warc-fields", about),
    )
    out = base.select(F.explode(records).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _headers(stream) -> list[tuple[str, str]] | None:
    """Name and value of each header line up to the blank one; None at the end of the archive."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found = []
    for line in iter(stream.readline, b""):
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.append((name.strip().lower(), value.strip()))
    return found


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzip, in order."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while (headers := _headers(stream)) is not None:
        of = dict(headers)
        block = stream.read(int(of.get("content-length") or 0))
        media, fields, payload = of.get("content-type", ""), None, block
        if media.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif media == "application/warc-fields":
            lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines())
            fields = {a.strip(): b.strip() for a, _, b in lines if a.strip()}
        yield {
            "record_id": of.get("warc-record-id"),
            "type": of.get("warc-type"),
            "uri": of.get("warc-target-uri"),
            "date": of.get("warc-date"),
            "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
            "refers_to": of.get("warc-refers-to"),
            "fields": fields,
            "payload": payload,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with payload_bytes and payload_digest (base32 SHA-1 of what the archive holds)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]
        for frame in frames:
            for content in frame["content"]:
                held, size = [], 0
                for record in parse_archive(content):
                    held.append(record)
                    size += len(record["payload"]) + 500
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, RECORDS).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))}
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the requests and metadata that are concurrent to it.

    Links count in either direction and over one satellite in between (metadata of a request of a response). A capture
    that the archive holds n times gives n equal rows; requests and metadata that repeat an id are one. Those that lead
    to no capture are left out; a capture without them has empty arrays. An empty archive gives no rows. Records may come
    without their payload column; then captures have none.
    """
    body = ["payload"] * ("payload" in records.columns)
    records = records.groupBy("record_id").agg(
        *[F.first(c).alias(c) for c in records.columns if c != "record_id"], F.count(F.lit(1)).alias("__copies")
    )
    anchors = records.filter(F.col("type").isin("response", "revisit"))
    others = records.filter(F.col("type").isin("request", "metadata"))
    ids = anchors.select(F.col("record_id").alias("capture_id"))
    links = others.select("record_id", F.explode("concurrent_to").alias("target"))
    straight = links.join(ids, links["target"] == ids["capture_id"]).select("record_id", "capture_id")
    back = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    direct = straight.unionByName(back).distinct()
    over = links.join(direct.withColumnRenamed("record_id", "target"), "target").select("record_id", "capture_id")
    member = direct.unionByName(over).distinct()
    satellites = (
        member.join(others, "record_id")
        .groupBy("capture_id")
        .agg(*[
            F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "uri", "date", *body, cast_fields())))).alias(name)
            for kind, name in (("request", "requests"), ("metadata", "metadata"))
        ])
    )
    empty = lambda c: F.coalesce(F.col(c), F.array())
    # in two steps, so that no array grows with the number of copies
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(1 << 12).cast("long")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("__copies") - F.col("__from"), F.lit(1 << 12))))
    joined = anchors.join(satellites, anchors["record_id"] == satellites["capture_id"], "left")
    return joined.withColumn("__from", some).withColumn("__nth", each).select(
        F.col("record_id").alias("capture_id"), "type", "uri", "date", "refers_to",
        F.struct(*body, "payload_bytes", "payload_digest").alias("response"), empty("requests").alias("requests"),
        empty("metadata").alias("metadata"),
    )


def cast_fields() -> Column:
    """Header fields as a sorted array of pairs; maps have no order to sort by."""
    return F.array_sort(F.map_entries(F.coalesce(F.col("fields"), F.create_map().cast("map<string,string>")))).alias("fields")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with ``original``: what a revisit refers to, as struct(capture_id, response, metadata); else null."""
    wanted = captures.filter("refers_to is not null").select(F.col("refers_to").alias("__id")).distinct()
    found = captures.join(wanted, captures["capture_id"] == wanted["__id"]).select(
        "__id", F.struct("capture_id", "response", "metadata").alias("original")
    ).dropDuplicates(["__id"])
    return captures.join(found, F.col("refers_to") == F.col("__id"), "left").drop("__id")
