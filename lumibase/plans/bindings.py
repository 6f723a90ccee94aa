"""The media library's tables as views over the given star schema (FIXTURES.md).

Each view is one SELECT that Spark and DuckDB both read, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_Y, _M, _D = "CAST(year({t}) AS STRING)", "lpad(CAST(month({t}) AS STRING), 2, '0')", "lpad(CAST(day({t}) AS STRING), 2, '0')"
_DAY = f"{_Y} || {_M} || {_D}".replace("{t}", "o_orderdate")
_ISO = f"{_Y} || '-' || {_M} || '-' || {_D}".replace("{t}", "o_orderdate")
_EURO = f"{_D} || '-' || {_M} || '-' || {_Y}".replace("{t}", "o_orderdate")
_EXIF = f"{_Y} || ':' || {_M} || ':' || {_D}".replace("{t}", "o_orderdate")
_RUN = f"{_Y} || CAST(month({{t}}) AS STRING) || {_D}".replace("{t}", "o_orderdate")
_EXT = "CASE o_orderkey % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'HEIC' WHEN 2 THEN 'mp4' WHEN 3 THEN 'opus' WHEN 4 THEN 'png' ELSE 'xyz' END"

VIEWS = {
    "files": f"""SELECT CAST(o_orderkey AS STRING) AS sha256, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS captured_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Camera' WHEN '2-HIGH' THEN 'Camera' WHEN '3-MEDIUM' THEN 'Screenshots' WHEN '5-LOW' THEN 'Saved' ELSE 'Adobe Photoshop' END AS category,
  CASE o_orderkey % 5 WHEN 0 THEN 'exif' WHEN 1 THEN 'takeout' WHEN 2 THEN 'filename' WHEN 3 THEN 'inferred_local' END AS date_source,
  CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'DateTimeOriginal' ELSE 'CreateDate' END WHEN 3 THEN CASE o_custkey % 4 WHEN 0 THEN 'CreateDate|TimeZone|+02:00' WHEN 1 THEN 'TrackCreateDate|TimeZone|-03:30' WHEN 2 THEN 'CreateDate|GPSDateStamp+filename:VID_|+05:45' ELSE 'MediaCreateDate|not_proven_utc' END END AS date_tag,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 1000 END AS perceptual,
  'IMG_' || {_DAY} || '_' || CAST(o_orderkey AS STRING) || '.' || {_EXT} AS original_name,
  '/src/' || CAST(o_custkey % 50 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.jpg' AS source_path,
  CASE WHEN o_orderkey % 11 = 0 THEN o_custkey END AS event_id
FROM {{orders}}""",
    "copies": """SELECT CAST(l_orderkey AS STRING) AS sha256, CAST(l_suppkey AS STRING) AS drive_uuid,
  CAST(2000 + l_suppkey % 30 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '.jpg' AS relative,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS copy_sha256,
  CAST(sum(l_quantity) AS BIGINT) AS size,
  max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS last_verified,
  max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS missing_at,
  max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS date_baked_at
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "drives": "SELECT CAST(s_suppkey AS STRING) AS uuid, s_name AS label FROM {supplier}",
    "items": """SELECT user_id AS library, event_id AS key, lpad(CAST(event_id AS STRING), 12, '0') AS sha256,
  ts - INTERVAL '1' DAY * (day(ts) - (day(ts) - (day(ts) - 1) % 10 + (day(ts) - 1) % 3)) - INTERVAL '1' HOUR * (hour(ts) - 10) AS captured_at, event_type AS category,
  CASE WHEN event_id % 6 > 0 THEN CAST(user_id * 7 % 120 - 60 + CASE WHEN user_id % 4 = 0 AND minute(ts) >= 30 THEN 1 ELSE 0 END AS DOUBLE) END AS lat,
  CASE WHEN event_id % 6 > 0 THEN CAST(user_id * 11 % 300 - 150 AS DOUBLE) END AS lon, CASE WHEN event_id % 5 = 0 THEN event_id END AS event_id,
  'Home Place/' || CASE WHEN event_id % 5 = 0 THEN 'DCIM' ELSE 'Trip' || CAST(user_id % 7 AS STRING) END || '/' || CAST(event_id AS STRING) || '.jpg' AS path
FROM {events}""",
    "media": f"""SELECT o_orderkey AS id,
  CASE o_orderkey % 14 WHEN 0 THEN 'IMG-' || {_DAY} || '-WA0020.jpg' WHEN 1 THEN 'Screenshot_' || {_DAY} || '_001427.png' WHEN 2 THEN 'IMG_' || {_DAY} || '_120000.jpg'
    WHEN 3 THEN 'photo_' || {_ISO} || '_12-30-45.jpg' WHEN 4 THEN 'photo_1@' || {_EURO} || '_09-30-00.jpg' WHEN 5 THEN 'VID_' || {_DAY} || '_101112.mp4'
    WHEN 6 THEN 'FB_IMG_' || CAST(o_custkey AS STRING) || '.jpg' WHEN 7 THEN 'IMG_1234.JPG' WHEN 8 THEN {_RUN} || '120755.jpg' WHEN 9 THEN 'twitter_' || CAST(o_custkey AS STRING) || '.jpg'
    WHEN 10 THEN 'holiday ' || {_ISO} || '.heic' WHEN 11 THEN 'Screen Shot ' || {_EURO} || '.png' WHEN 12 THEN 'image (3).webp' ELSE 'clip.MOV' END AS name,
  CASE WHEN o_custkey % 3 = 0 THEN ' Samsung ' END AS make,
  CASE WHEN o_custkey % 4 = 0 THEN 'SM-A546B' WHEN o_custkey % 4 = 1 THEN '' END AS model,
  CASE o_custkey % 5 WHEN 0 THEN 'Adobe Photoshop 24.0 (Windows)' WHEN 1 THEN 'Android BP4A.251205' WHEN 2 THEN 'Snap/Seed' END AS software,
  CASE WHEN o_custkey % 17 = 0 THEN 'Screenshot' END AS samsung,
  CASE WHEN o_custkey % 6 < 3 THEN 1080 ELSE 4000 END AS width, CASE WHEN o_custkey % 2 = 0 THEN 1350 ELSE 3000 END AS height,
  CASE o_custkey % 8 WHEN 0 THEN {_EXIF} || ' 10:11:12' WHEN 1 THEN '0000:00:00 00:00:00' WHEN 2 THEN {_EXIF} || ' 10:11:12.753+02:00' WHEN 3 THEN '1904:01:01 00:00:00'
    WHEN 4 THEN '2051:01:01 00:00:00' WHEN 5 THEN '2000:01:01 00:00:00' WHEN 6 THEN {_ISO} END AS dto,
  CASE o_custkey % 3 WHEN 0 THEN {_EXIF} || CASE WHEN o_custkey % 5 IN (1, 2) THEN ' 08:11:42' ELSE ' 08:11:12' END WHEN 1 THEN '1850:01:02 03:04:05' END AS created,
  CASE WHEN o_custkey % 11 = 5 THEN {_EXIF} || ' 07:00:00+05:30' END AS creation,
  CASE o_custkey % 13 WHEN 4 THEN {_EXIF} || ' 06:11:12' WHEN 5 THEN '1970:01:01 00:00:00' END AS media_created, CASE WHEN o_custkey % 17 < 4 THEN {_EXIF} || ' 05:11:12' END AS track_created,
  CASE WHEN o_custkey % 19 < 9 THEN {_EXIF} || ' 04:00:00' END AS date_created,
  CASE o_custkey % 8 WHEN 0 THEN '+02:00' WHEN 2 THEN '-03:30' WHEN 4 THEN '+05:45' END AS zone,
  CASE o_custkey % 5 WHEN 1 THEN '0:00:30' WHEN 2 THEN '30 s' WHEN 3 THEN '0:30:00' END AS duration,
  CASE WHEN o_custkey % 7 < 2 THEN {_EXIF} END AS gps_day, CASE o_custkey % 7 WHEN 0 THEN '08:11:14' WHEN 1 THEN '09:00:00.5' END AS gps_time,
  CASE WHEN o_custkey % 23 = 8 THEN 'video/mp4' END AS mime,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS taken_at, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL '40' DAY END AS uploaded_at
FROM {{orders}}""",
    "docs": """SELECT doc_id, path, sha256, size, b - b % 8 + size % 8 AS perceptual, part FROM (SELECT doc_id, '/' || source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS path, md5(text) AS sha256,
  n_chars AS size, <HEX60 CAST(n_chars - n_chars % 8 AS STRING)> AS b, doc_id % 4 AS part FROM {documents})""",
    "shots": """SELECT id, path, size, sha256, b - b % 4 + id % 4 AS perceptual, part FROM (SELECT o_orderkey AS id, '/b/' || CAST(o_orderkey AS STRING) || '.jpg' AS path, CAST(floor(o_totalprice / 100) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 50 <> 7 THEN md5(CAST(o_orderkey - o_orderkey % 3 AS STRING)) END AS sha256, <HEX60 CAST(o_orderkey - o_orderkey % 8 AS STRING)> AS b, o_orderkey % 4 AS part FROM {orders})""",
}
_BASE = {"files": "orders", "copies": "lineitem", "drives": "supplier", "items": "events", "media": "orders", "docs": "documents", "shots": "orders"}


#: 60 bits of a text's digest, which the two engines write differently.
HEX60 = re.compile(r"<HEX60 (.*?)>")


class Tables:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        base = _BASE[name]
        return self.spark.sql(HEX60.sub(r"CAST(conv(substr(md5(\1), 1, 15), 16, 10) AS BIGINT)", VIEWS[name]), **{base: self.raw(base)})

    files = cached_property(lambda self: self.view("files"))
    copies = cached_property(lambda self: self.view("copies"))
    drives = cached_property(lambda self: self.view("drives"))
    items = cached_property(lambda self: self.view("items"))
    docs = cached_property(lambda self: self.view("docs"))
    shots = cached_property(lambda self: self.view("shots"))

    @cached_property
    def media(self) -> DataFrame:
        """With the metadata as a struct, tags."""
        rows = self.view("media")
        cores = self.spark.sparkContext.defaultParallelism
        if len(self.raw("orders").inputFiles()) < cores:  # a small file is one task, and dates are work for all cores
            rows = rows.repartition(cores)
        tags = F.struct(
            F.col("make").alias("Make"), F.col("model").alias("Model"), F.col("software").alias("Software"), F.col("samsung").alias("SamsungCaptureInfo"),
            F.col("width").alias("ImageWidth"), F.col("height").alias("ImageHeight"), F.col("dto").alias("DateTimeOriginal"), F.col("created").alias("CreateDate"), F.col("zone").alias("TimeZone"),
            F.col("creation").alias("CreationDate"), F.col("media_created").alias("MediaCreateDate"), F.col("track_created").alias("TrackCreateDate"), F.col("date_created").alias("DateCreated"),
            F.col("gps_day").alias("GPSDateStamp"), F.col("gps_time").alias("GPSTimeStamp"), F.col("duration").alias("Duration"), F.col("mime").alias("MIMEType"), F.lit(None).cast("string").alias("LensModel"),
        )
        return rows.withColumn("tags", tags)


for _name in ("files", "copies", "drives", "items", "docs", "shots"):
    getattr(Tables, _name).__set_name__(Tables, _name)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    own = {n: HEX60.sub(r"CAST('0x' || substr(md5(\1), 1, 15) AS BIGINT)", VIEWS[n]) for n in used}
    views = [f"{n} AS ({own[n].replace('{' + _BASE[n] + '}', _BASE[n])})" for n in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*views, body[5:]])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
