"""A content-addressed WARC archive.

Each payload is stored once, under its SHA-256; the header of each record, byte for byte, is stored in a second table
beside that digest. Joining the two and putting header and payload together gives the original records again. What is
read back is verified: the payload against its digest, and the header's payload digest and Content-Length against the
payload; a mismatch raises ValueError. The payload itself only crosses the join if the reader asks for it.

Payloads that several workers meet are cut down to one each before the shuffle, and to one in all after it, so a
payload that a third of all pages share costs one copy a worker.

Defined results: a null payload is empty. Of records with equal payloads of at least ``least_bytes`` bytes, that with
the largest id is the response and the others revisit it; rows that share that id as well as the payload are one
record written several times and are all responses. A null id is smaller than any other. Smaller payloads are all
responses. A null url is an empty target. An empty table gives an archive without records. Further columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import materialize, small_batches, text_or_empty

#: The date of every record, so that archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header() -> Column:
    """The header of a record from the columns id, url, kind, sha1, size and best."""
    record = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("kind") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: "), record("id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record("best"))),
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws("\r\n", *lines).cast("binary")


def _fields(header: bytes) -> dict[str, str]:
    first, *lines = header.decode().split("\r\n")
    if first != "WARC/1.1" or lines[-2:] != ["", ""]:
        raise ValueError("no WARC header")
    return dict(line.split(": ", 1) for line in lines[:-2])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, payload) -> (id, url, digest, sha1, size)."""
    for batch in batches:
        payloads = batch.column(2).to_pylist()
        made = [
            pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
            pa.array([payload_digest(p) for p in payloads], pa.string()),
            pa.array(map(len, payloads), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "url", "digest", "sha1", "size"])


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write a record for each row to ``path``: the tables headers (id, digest, header) and payloads (digest, payload)."""
    small_batches(pages.sparkSession, 500)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), text_or_empty(url_col).alias("url"), text_or_empty(payload_col).cast("binary").alias("payload"))
    stored = rows.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload").dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = materialize(rows.mapInArrow(_digested, f"id {id_type}, url string, digest binary, sha1 string, size bigint"), "facts")
    best = facts.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("id").alias("best"))
    kind = F.when(F.col("best").isNull() | F.col("best").eqNullSafe(F.col("id")), "response").otherwise("revisit")
    headers = facts.join(best, "digest", "left").withColumn("kind", kind).select("id", "digest", _header().alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stored payload with its SHA-1 and size, once its SHA-256 is found to be its key."""
    for batch in batches:
        payloads = batch.column(1).to_pylist()
        for key, payload in zip(batch.column(0).to_pylist(), payloads, strict=True):
            if hashlib.sha256(payload).digest() != key:
                raise ValueError(f"payload {key.hex()} is damaged")
        made = [pa.array([payload_digest(p) for p in payloads], pa.string()), pa.array(map(len, payloads), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["digest", "payload", "payload_digest", "payload_bytes"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [_fields(h) for h in batch.column(2).to_pylist()]
        names = ("WARC-Type", "WARC-Payload-Digest", "Content-Length", "WARC-Refers-To")
        found = [pa.array([f.get(n) for f in fields], pa.string()) for n in names]
        yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["id", "digest", "header", "record_type", "said", "length", "refers"])


def read_archive(pages_schema_id: str, path: str, spark, *, id_col: str = "page_id") -> DataFrame:
    """The records of an archive: id, record_type, refers_to, payload_digest, payload_bytes, header, payload and
    record (header, block and the closing empty lines). ``pages_schema_id`` is the id's type."""
    small_batches(spark, 500)
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    headers = spark.read.schema(f"id {pages_schema_id}, digest binary, header binary").parquet(f"{path}/headers")
    payloads = payloads.mapInArrow(_verified, "digest binary, payload binary, payload_digest string, payload_bytes bigint")
    parsed = headers.mapInArrow(_parsed, f"id {pages_schema_id}, digest binary, header binary, record_type string, said string, length string, refers string")
    both = parsed.join(payloads, "digest", "left")
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = F.col("said").eqNullSafe(F.concat(F.lit("sha1:"), "payload_digest")) & F.col("length").eqNullSafe(size.cast("string"))
    kind = F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.lit("a record's header does not fit its payload")))
    end = F.lit(b"\r\n\r\n")
    return both.select(
        F.col("id").alias(id_col),
        kind.alias("record_type"),
        F.regexp_extract("refers", "^<urn:record:(.*)>$", 1).try_cast(pages_schema_id).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        "header",
        "payload",
        F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"),
    )
