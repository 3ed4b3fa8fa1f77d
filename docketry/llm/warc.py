"""WARC archives with revisit records for equal payloads.

Headers alone are shuffled by payload digest to find the first record of each payload; rows then join that
list, and archives are written as records with fresh headers, the payload only once.  Reading gives
responses and revisits back, and revisits join the responses they refer to.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import materialise, only, text_or_empty

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of one archive file at most.
FILE_ROWS = 4096

PARSED = "row_id long, uri string, warc_type string, block_bytes long, payload_bytes long, payload_digest string, refers_to_row long, payload string"


def _headers(df: DataFrame, id_col: str, payload_col: str, uri_col: str) -> DataFrame:
    """Each row's id, address without control characters, payload, its digest and its length in bytes."""
    payload = text_or_empty("payload")
    return only(df, row_id=id_col, uri=uri_col, payload=payload_col).select(
        F.col("row_id").cast("long").alias("row_id"),
        F.regexp_replace(text_or_empty("uri"), r"[\x00-\x20\x7F]", "").alias("uri"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )


def first_records(headers: DataFrame, min_bytes: int) -> DataFrame:
    """For each payload of at least ``min_bytes`` that occurs again: digest, the smallest row id and its address.

    Counts are taken before the shuffle, so a payload that a third of all rows share costs one row per task.
    """
    groups = headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("row_id").alias("first_id"), F.min_by("uri", "row_id").alias("first_uri"), F.count(F.lit(1)).alias("n"))
    return materialise(groups.where("n > 1 AND first_id IS NOT NULL").drop("n"), "warc-first")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row to gzip-compressed WARC files under ``path``.

    Of equal payloads of at least ``min_bytes`` the row with the smallest id is a response and the others are
    revisits; rows that repeat that id are responses too, since a record can't revisit itself.  A null id sorts
    last: it revisits the group's smallest id, or is a response where there is none.  Null payloads are empty.
    Record ids are unique: those of null and repeated row ids take the row's place in the write as well, so a revisit
    of such a row names it by address alone.
    """
    headers = _headers(df, id_col, payload_col, uri_col)
    first = first_records(headers.select("row_id", "uri", "digest", "bytes"), min_bytes)
    repeated = materialise(headers.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND row_id IS NOT NULL").select("row_id", F.lit(True).alias("again")), "warc-repeated")
    first = first.join(repeated.select(F.col("row_id").alias("first_id"), F.col("again").alias("first_again")), "first_id", "left")
    rows = headers.join(first, "digest", "left").join(repeated, "row_id", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("bytes") >= min_bytes) & ~F.col("row_id").eqNullSafe(F.col("first_id"))

    def urn(c, place=None):
        x = F.md5(F.concat_ws(" ", F.lit("record"), c.cast("string"), *([] if place is None else [place])))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(x, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    def lines(*parts):
        return F.concat_ws(CRLF, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def field(name, value):
        return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")))

    http = lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", field("Content-Length", F.col("bytes")), "", "")
    common = [field("WARC-Record-ID", urn(F.col("row_id"), F.when(F.col("row_id").isNull() | F.col("again"), F.concat(F.lit("place "), F.monotonically_increasing_id().cast("string"))))), f"WARC-Date: {date}", field("WARC-Target-URI", F.col("uri")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), field("X-Row-ID", F.col("row_id"))]
    kind = "Content-Type: application/http; msgtype=response"
    response = F.concat(lines("WARC/1.1", "WARC-Type: response", *common, kind, field("Content-Length", F.octet_length(http) + F.col("bytes")), "", ""), http, F.col("payload"))
    again = F.concat(lines("WARC/1.1", "WARC-Type: revisit", f"WARC-Profile: {PROFILE}", *common, F.when(F.col("first_again").isNull(), field("WARC-Refers-To", urn(F.col("first_id")))), field("WARC-Refers-To-Target-URI", F.col("first_uri")), field("X-Refers-To-Row-ID", F.col("first_id")), kind, field("Content-Length", F.octet_length(http)), "", ""), http)
    # two line ends close a record, so they serve as the text sink's separator
    rows.select(F.when(revisit, again).otherwise(response).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of an uncompressed WARC stream; blocks are cut by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record was expected, not {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def _parse(batches: Iterator[pd.DataFrame], keep_payload: bool) -> Iterator[pd.DataFrame]:
    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"row_id": "Int64", "refers_to_row": "Int64"})

    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for fields, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                _, _, payload = block.partition(b"\r\n\r\n")
                declared, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != declared:
                    raise ValueError(f"record {fields['warc-record-id']} doesn't match its digest")
                row, refers = fields.get("x-row-id"), fields.get("x-refers-to-row-id")
                rows.append((int(row) if row else None, fields.get("warc-target-uri"), kind, len(block), len(payload) if kind == "response" else None, declared, int(refers) if refers else None, payload.decode("utf-8") if keep_payload and kind == "response" else None))
                held += len(block) if keep_payload else 200
                if held > 4_000_000:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; the digest of each response is computed anew and compared."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(lambda it: _parse(it, keep_payload), PARSED)


def resolve_revisits(parsed: DataFrame) -> DataFrame:
    """Join revisits to the responses they refer to: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit has the length of its response's payload.  The responses referred to are a table of their own,
    one row for each digest and id, so that Spark can split the revisits of a payload that many rows share.
    """
    parsed = materialise(parsed.drop("payload"), "warc-parsed")
    revisits = parsed.where("warc_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.groupBy("refers_to_row", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    found = parsed.where("warc_type = 'response'").groupBy(F.col("row_id").alias("refers_to_row"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    origins = materialise(found.join(wanted, ["refers_to_row", "payload_digest"]).drop("n"), "warc-origins")
    back = revisits.join(origins, ["refers_to_row", "payload_digest"], "left")
    return parsed.where("warc_type = 'response'").unionByName(back).select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_row").alias("refers_to"), F.col("uri").alias("url"),
    )
