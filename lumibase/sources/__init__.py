"""Readers and writers of listings, metadata, sidecars, catalogs and decision documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumibase.functions.dates import DATE_TAGS
from lumibase.operators.decisions import is_machine_local
from lumibase.operators.stages import written

METADATA_SCHEMA = "path string, tags struct<" + ", ".join(
    f"{t}: string" for t in ("Make", "Model", "LensModel", "Software", "SamsungCaptureInfo", *DATE_TAGS, "GPSDateStamp", "GPSTimeStamp", "TimeZone", "Duration", "MIMEType")
) + ", GPSLatitude: double, GPSLongitude: double, ImageWidth: int, ImageHeight: int, Orientation: int>"
TIME, PLACE = "struct<timestamp: string>", "struct<latitude: double, longitude: double>"
SIDECAR_SCHEMA = f"photoTakenTime {TIME}, creationTime {TIME}, geoDataExif {PLACE}, geoData {PLACE}, description string, title string"
DECISION_SCHEMA = "drive_uuid string, drive_label string, written timestamp, sections array<struct<section: string, key: string, value: string>>"


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import os

    for batch in batches:
        rows = []
        for folder in batch["path"]:
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                is_dir = e.is_dir(follow_symlinks=False)
                s = e.stat(follow_symlinks=False)
                rows.append((e.path, None if is_dir else s.st_size, pd.Timestamp(s.st_mtime_ns // 1000, unit="us"), "hidden" if e.name.startswith(".") else "dir" if is_dir else "file"))
        yield pd.DataFrame(rows, columns=["path", "length", "mtime", "kind"])


def read_listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per entry below the roots (path, length, mtime, kind); hidden folders are named, and not entered.
    Folders are listed by executors, one level at a time until a level has none; executors must see the roots. Each level is
    written, so that no folder is listed twice, also if executors are lost."""
    level = spark.createDataFrame([(r,) for r in roots], "path string")
    found = None
    while True:
        below = written(level.repartition("path").mapInPandas(_listed, "path string, length bigint, mtime timestamp_ntz, kind string"), "listing")
        found = below if found is None else found.unionByName(below)
        level = below.where("kind = 'dir'").select("path")
        if level.isEmpty():
            return found


def read_metadata(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Tag records; a tag that a file lacks is null. Records of lines of JSON keep tags that nothing here knows, as a
    map of JSON texts (more)."""
    if fmt != "json":
        return spark.read.schema(METADATA_SCHEMA).format(fmt).load(path)
    known = spark.range(0).select(F.from_json(F.lit(""), METADATA_SCHEMA).alias("m")).schema["m"].dataType["tags"].dataType.names
    lines = spark.read.text(path).where(F.trim("value") != "")
    records = lines.select(F.from_json("value", METADATA_SCHEMA).alias("m"), F.expr("try_cast(try_variant_get(try_parse_json(value), '$.tags') AS map<string, variant>)").alias("all"))
    more = F.transform_values(F.map_filter("all", lambda k, _: ~k.isin(*known)), lambda _, v: F.to_json(v))
    return records.select("m.path", "m.tags", more.alias("more"))


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """S3: folder, name and content as text -> times (UTC), place and description; a malformed one keeps its row, with
    nulls. A place of (0, 0) is none; the embedded one goes first."""
    j = F.from_json("content", SIDECAR_SCHEMA)
    rows = texts.withColumn("j", j)
    at = lambda c: F.timestamp_seconds(F.col(f"j.{c}.timestamp").try_cast("bigint")).cast("timestamp_ntz")
    point = lambda c: F.when((F.col(f"j.{c}.latitude") != 0) | (F.col(f"j.{c}.longitude") != 0), F.col(f"j.{c}"))
    place = F.coalesce(point("geoDataExif"), point("geoData"))
    return rows.select("folder", "name", at("photoTakenTime").alias("taken_at"), at("creationTime").alias("created_at"), place["latitude"].alias("lat"), place["longitude"].alias("lon"), F.nullif(F.trim("j.description"), F.lit("")).alias("description"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_sidecars(texts.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("value").alias("content")))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """One row per thing that a document says; sections that are unknown are kept as they are."""
    docs = spark.read.schema(DECISION_SCHEMA).option("multiLine", True).json(path)
    return docs.select("drive_uuid", "written", F.inline("sections"))


def decision_documents(rows: DataFrame) -> DataFrame:
    """One document per drive, without the settings that belong to one machine. A document is what one drive's owner
    has decided by hand, and so small; its rows are gathered on one worker."""
    kept = rows.where(~((F.col("section") == "settings") & is_machine_local(F.col("key"))))
    return kept.groupBy("drive_uuid").agg(F.max("written").alias("written"), F.collect_list(F.struct("section", "key", "value")).alias("sections"))


def write_decisions(rows: DataFrame, path: str) -> None:
    """Each drive's document in a file of its own."""
    decision_documents(rows).withColumn("drive", F.col("drive_uuid")).write.mode("overwrite").partitionBy("drive").json(path)


def write_run_record(outcomes: DataFrame, path: str) -> None:
    """Per-file outcomes, one folder a run."""
    outcomes.write.mode("append").partitionBy("run_id").parquet(path)
