"""WARC archives of pages in which repeated payloads are written as revisit records."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

LEAST_PAYLOAD = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def resolve_revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Payload headers of every page: ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Only headers are shuffled. The first page of a digest is a minimum, combined before the shuffle,
    so a payload that a third of all pages share costs one row per task. Pages of fewer than ``least``
    bytes are always responses. Rows that repeat the smallest page_id of their payload are all
    responses; null html is an empty payload.
    """
    heads = pages.select(
        "page_id",
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_digest"),
    )
    long_enough = F.col("payload_bytes") >= least
    firsts = (
        heads.filter(long_enough)
        .groupBy(F.col("payload_digest").alias("_z_digest"))
        .agg(F.min("page_id").alias("_z_first"), F.count(F.lit(1)).alias("_z_n"))
        .filter("_z_n > 1")
        .drop("_z_n")
    )
    joined = heads.join(firsts, long_enough & (F.col("payload_digest") == F.col("_z_digest")), "left")
    again = F.coalesce(F.col("page_id") > F.col("_z_first"), F.lit(False))
    return joined.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_z_first")).alias("refers_to"),
    )


def _uri(column) -> F.col:
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_PAYLOAD) -> None:
    """Write one WARC/1.1 record per page below ``path``, as gzip files that any task can read alone.

    Every record has fresh headers. A response holds an HTTP header and the payload, a revisit the
    HTTP header alone and a reference to its response. Pages are joined with the rows of revisits
    only; payloads meet no other payload. A repeated page_id writes a record per row.
    """
    revisits = (
        resolve_revisits(pages, least)
        .filter("record_type = 'revisit'")
        .select(F.col("page_id").alias("_z_page"), F.col("payload_digest").alias("_z_digest"), F.col("refers_to").alias("_z_to"))
        .distinct()
    )
    body = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("_z_body")).withColumn(
        "_z_sha", F.sha2(F.col("_z_body").cast("binary"), 256)
    )
    joined = own.join(revisits, (F.col("page_id") == F.col("_z_page")) & (F.col("_z_sha") == F.col("_z_digest")), "left")
    again = F.col("_z_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("_z_body").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("_z_body")))
    clean_url = F.regexp_replace("url", r"[\r\n]", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _uri(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        clean_url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"),
        F.col("_z_sha"),
        F.when(
            again,
            F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), _uri(F.col("_z_to")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}")),
        ).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
    )
    # The line separator of the writer is the blank line that ends a record.
    joined.select(head.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", 20_000
    ).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, found by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield head, block
        at = end + 8 + size


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. The digest of a response is taken from its payload again and must match."""

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in parse_records(gzip.decompress(content)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    rows.append(
                        (_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), head["WARC-Target-URI"])
                    )
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                for c in ("page_id", "payload_bytes", "refers_to"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, RECORD)
