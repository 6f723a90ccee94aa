"""Queries over names, metadata, duplicates, the timeline, layouts and decisions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.functions import dates, measures, origin, paths
from lumibase.operators import decisions, duplicates, sidecars, timeline
from lumibase.operators import copies as on_drives
from lumibase.operators.stages import fresh_path, written
from lumibase import streaming
from lumibase.sources import documents
from lumibase.streaming import corrections
from lumibase.streaming.runs import files, rocks_store, run, to_files
from lumibase.plans import pipelines
from lumibase.plans.custody import SENTENCE
from lumibase.plans.registry import query

NOW = "2024-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


MESSENGER = r"""CASE WHEN regexp_matches(name, '^(IMG|VID|AUD|PTT|DOC|STK)-[0-9]{8}-WA[0-9]+', 'i') THEN 'WhatsApp'
 WHEN regexp_matches(name, '^(photo|video|audio|file)_[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2}', 'i') THEN 'Telegram'
 WHEN regexp_matches(name, '^(photo|video|audio|file)_[0-9]+@[0-9]{2}-[0-9]{2}-[0-9]{4}_[0-9]{2}-[0-9]{2}-[0-9]{2}', 'i') THEN 'Telegram'
 WHEN regexp_matches(name, '^(FB_IMG|FB_VID|received_)', 'i') THEN 'Facebook' WHEN regexp_matches(name, '^twitter_', 'i') THEN 'Twitter'
 WHEN regexp_matches(name, '^(download|unnamed|image)\s*\([0-9]+\)', 'i') THEN 'Downloads' END"""
FAMILY = "CASE WHEN software LIKE 'Adobe%' THEN 'Adobe Photoshop' WHEN software LIKE 'Snap%' THEN 'Snap Seed' END"
CAPTURE = r"regexp_matches(name, '^(IMG|VID)_(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])_([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]($|[^0-9])', 'i')"  # no digit may follow
RULES = f"""o AS (SELECT *, {MESSENGER} AS app, {FAMILY} AS family, coalesce(trim(model), '') AS mdl, coalesce(trim(make), '') AS mk FROM media),
r AS (SELECT *, CASE WHEN lower(samsung) = 'screenshot' THEN 'screenshot_metadata' WHEN regexp_matches(name, '^screen[ _-]?shot[ _.-]', 'i') THEN 'screenshot_name' WHEN mdl = '' AND app IS NOT NULL THEN 'filename_convention'
 WHEN family IS NOT NULL THEN 'software' WHEN mdl <> '' THEN 'device' WHEN {CAPTURE} THEN 'camera_filename' WHEN mk = '' AND mdl = '' AND width * height <= 2000000 THEN 'saved_heuristic' ELSE 'fallback' END AS rule FROM o),
c AS (SELECT *, CASE rule WHEN 'screenshot_metadata' THEN 'Screenshots' WHEN 'screenshot_name' THEN 'Screenshots' WHEN 'filename_convention' THEN app WHEN 'software' THEN family WHEN 'device' THEN 'Camera' WHEN 'camera_filename' THEN 'Camera' ELSE 'Saved' END AS label,
 CASE rule WHEN 'screenshot_metadata' THEN 'high' WHEN 'software' THEN 'low' WHEN 'saved_heuristic' THEN 'low' WHEN 'fallback' THEN 'low' ELSE 'medium' END AS confidence FROM r)"""


def _classified(t, **by):
    m = origin.classify(F.col("name"), F.col("tags"), origin.rules(**by) if by else None)
    return t.media.withColumn("m", m)


query("c1_c8_classify", f"WITH {RULES} SELECT id, label, confidence, rule FROM c")(lambda t: _classified(t).select("id", "m.label", "m.confidence", "m.rule"))
query("c5_by_device", f"WITH {RULES} SELECT id, CASE WHEN rule = 'device' THEN trim(mk || ' ' || mdl) ELSE label END AS label FROM c")(lambda t: _classified(t, by_device=True).select("id", "m.label"))
query("c9_messenger_names", f"SELECT id, {MESSENGER} IS NOT NULL AS messenger FROM media")(lambda t: t.media.select("id", origin.is_messenger_name(F.col("name")).alias("messenger")))
query("c10_sanitize_label", r"""SELECT p_partkey, CASE WHEN v = '' THEN 'Saved' ELSE v END AS label FROM (SELECT p_partkey, rtrim(trim(substr(trim(regexp_replace(regexp_replace('a/b: ' || p_name || '. ', '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g'), ' .'), 1, 60)), ' .') v FROM part)""")(
    lambda t: t.raw("part").select("p_partkey", origin.sanitize_label(F.concat(F.lit("a/b: "), "p_name", F.lit(". "))).alias("label")))
query("c11_c12_routes", f"WITH {RULES} SELECT label, rule, count(*) AS files, label IN ('Screenshots', 'Saved', 'WhatsApp', 'Telegram', 'Facebook', 'Twitter', 'Downloads') AS side_bin, rule IN ('device', 'camera_filename') AS timeline FROM c GROUP BY label, rule")(
    lambda t: _classified(t).groupBy("m.label", "m.rule").agg(F.count("*").alias("files")).select("label", "rule", "files", origin.is_side_bin(F.col("label")).alias("side_bin"), origin.is_timeline(F.col("rule")).alias("timeline")))
query("c13_c14_scan_partition", r"""SELECT id, CASE id % 4 WHEN 0 THEN 'hidden' WHEN 1 THEN 'original_backup' WHEN 2 THEN 'media' ELSE CASE WHEN id % 3 = 0 THEN 'document' ELSE 'unrecognized' END END AS partition FROM media""")(
    lambda t: t.media.selectExpr("id", "CASE id % 4 WHEN 0 THEN '.' || name WHEN 1 THEN name || '_original' WHEN 2 THEN name ELSE CASE WHEN id % 3 = 0 THEN 'a.PDF' ELSE 'a.exe' END END AS name").select("id", origin.scan_partition(F.col("name")).alias("partition")))
query("c15_year_folders", "SELECT o_orderkey, o_orderkey % 4 = 0 AS year_folder FROM orders")(
    lambda t: t.raw("orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'Photos from ' || CAST(year(o_orderdate) AS STRING) WHEN 1 THEN 'Photos from ' || CAST(month(o_orderdate) AS STRING) WHEN 2 THEN 'photos from ' || CAST(year(o_orderdate) AS STRING) ELSE 'Photos from ' || CAST(year(o_orderdate) AS STRING) || ' b' END AS f").select("o_orderkey", origin.is_year_folder(F.col("f")).alias("year_folder")))
# folders named by a part's columns: the first thirteen kinds are junk whatever the values, the others name something
FOLDERS = """CASE p_partkey % 18 WHEN 0 THEN CAST(1980 + p_size AS STRING) WHEN 1 THEN lpad(CAST(p_size AS STRING), 3, '0') || 'APPLE' WHEN 2 THEN lpad(CAST(p_size AS STRING), 3, '0') || '_PANA' WHEN 3 THEN 'New folder (' || CAST(p_size AS STRING) || ')'
 WHEN 4 THEN CAST(1980 + p_size AS STRING) || '-07-29' WHEN 5 THEN 'Day ' || CAST(p_size AS STRING) WHEN 6 THEN 'takeout-' || p_name WHEN 7 THEN 'Copy of ' || p_name WHEN 8 THEN '(' || CAST(p_size AS STRING) || ')' WHEN 9 THEN 'IMG_' || CAST(p_partkey AS STRING)
 WHEN 10 THEN md5(p_name) WHEN 11 THEN 'August ' || CAST(1980 + p_size AS STRING) WHEN 12 THEN ' ' WHEN 13 THEN p_name WHEN 14 THEN p_name || ' ' || CAST(1980 + p_size AS STRING) WHEN 15 THEN 'Summer ' || CAST(1980 + p_size AS STRING) WHEN 16 THEN 'Test Match ' || p_brand ELSE 'Augusta ' || p_type END"""
query("c18_junk_folders", f"SELECT p_partkey, {FOLDERS} AS folder, p_partkey % 18 < 13 AS junk FROM part")(
    lambda t: t.raw("part").selectExpr("p_partkey", f"{FOLDERS} AS folder").select("p_partkey", "folder", origin.is_junk_folder(F.col("folder")).alias("junk")))
query("c19_oversized", "SELECT sha256, size > 300000 AS oversized FROM files")(lambda t: t.files.select("sha256", origin.is_oversized(F.col("size"), 300000).alias("oversized")))

SHOTS = """rs AS (SELECT *, part > 0 b, CASE WHEN sha256 IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) END n FROM shots),
us AS (SELECT path, b, perceptual FROM rs WHERE n = 1), cs AS (SELECT DISTINCT x.path FROM us x JOIN us y ON (y.b, y.path) < (x.b, x.path) AND bit_count(xor(x.perceptual, y.perceptual)) <= 5 WHERE x.b),
ks AS (SELECT rs.*, CASE WHEN sha256 IS NULL THEN 'unreadable' WHEN n > 1 THEN 'exact' WHEN cs.path IS NOT NULL THEN 'near' ELSE 'unique' END bucket FROM rs LEFT JOIN cs USING (path) WHERE rs.b)"""

FILENAME_DATE = f"""CASE id % 14 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 9 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN NULL WHEN 8 THEN CASE WHEN year(od) >= 2000 AND NOT (month(od) = 1 AND day(od) % 10 >= 1 AND day(od) < 30) THEN date_trunc('day', od)::TIMESTAMP END ELSE date_trunc('day', od)::TIMESTAMP END"""
DATED = f"d AS (SELECT media.*, o_orderdate od FROM media JOIN orders ON o_orderkey = id)"
query("f3_f4_date_from_filename", f"WITH {DATED} SELECT id, {FILENAME_DATE} AS value FROM d")(lambda t: t.media.select("id", dates.date_from_filename(F.col("name")).alias("value")))
query("f5_filename_capture_date", f"WITH {DATED} SELECT id, CASE WHEN ({MESSENGER}) IS NULL THEN {FILENAME_DATE} END AS value FROM d")(lambda t: t.media.select("id", dates.filename_capture_date(F.col("name")).alias("value")))
DTO = "CASE WHEN dto LIKE '0000%' THEN NULL WHEN length(dto) = 10 THEN try_strptime(dto, '%Y-%m-%d') ELSE try_strptime(substr(dto, 1, 19), '%Y:%m:%d %H:%M:%S') END"
query("f1_f2_parse_exif", f"SELECT id, {DTO} AS value FROM media")(lambda t: t.media.select("id", dates.parse_exif_datetime(F.col("dto")).alias("value")))
_AT = lambda c: f"try_strptime(substr({c}, 1, 19), '%Y:%m:%d %H:%M:%S')"
#: The six tags in order, what is wrong with each, the first that is not, and what was wrong with those before it.
EMBED = f"""e AS (SELECT d.*, list_filter([{{'t': 'DateTimeOriginal', 'v': {DTO}}}, {{'t': 'CreationDate', 'v': {_AT("creation")}}}, {{'t': 'CreateDate', 'v': {_AT("created")}}}, {{'t': 'MediaCreateDate', 'v': {_AT("media_created")}}},
  {{'t': 'TrackCreateDate', 'v': {_AT("track_created")}}}, {{'t': 'DateCreated', 'v': {_AT("date_created")}}}], lambda r: r.v IS NOT NULL) fs FROM d),
k AS (SELECT *, list_transform(fs, lambda r: CASE WHEN r.v IN (TIMESTAMP '1904-01-01', TIMESTAMP '1970-01-01') THEN 'sentinel' WHEN r.v > TIMESTAMP '{NOW}' + INTERVAL 2 DAY THEN 'future' WHEN year(r.v) < 1900 THEN 'early' ELSE 'ok' END) ks FROM e),
q AS (SELECT *, coalesce(list_position(ks, 'ok'), 0) p FROM k), x AS (SELECT *, CASE WHEN p > 0 THEN fs[p].v END val, CASE WHEN p > 0 THEN fs[p].t END tg, CASE WHEN p = 0 THEN ks ELSE ks[1:p - 1] END bad FROM q)"""
query("f6_f9_embedded_date", f"WITH {DATED}, {EMBED} SELECT id, val AS value, tg AS tag, list_contains(bad, 'sentinel') AS sentinel, list_contains(bad, 'future') AS future, list_contains(bad, 'early') AS early FROM x")(
    lambda t: dates.with_embedded_date(t.media, _now(), out="e").select("id", "e.value", "e.tag", "e.sentinel", "e.future", "e.early"))
#: The zone's minutes, or else the one offset between the stamp and the name's clock; a position's clock adds to the evidence.
RESOLVED = f"""y AS (SELECT *, CASE WHEN ({MESSENGER}) IS NULL THEN {FILENAME_DATE} END fd, (regexp_matches(lower(name), '[.](mp4|mov)$') OR coalesce(mime LIKE 'video/%', false)) AND tg IN ('CreateDate', 'MediaCreateDate', 'TrackCreateDate') AS vid,
  CASE id % 14 WHEN 2 THEN date_trunc('day', od) + INTERVAL 12 HOUR WHEN 5 THEN date_trunc('day', od) + INTERVAL 36672 SECOND END dev, CASE id % 14 WHEN 2 THEN 'filename:IMG_' WHEN 5 THEN 'filename:VID_' END dn, CASE zone WHEN '+02:00' THEN 120 WHEN '-03:30' THEN -210 WHEN '+05:45' THEN 345 END zm,
  CASE WHEN duration = '0:30:00' THEN 1800 WHEN duration IS NOT NULL THEN 30 END dur, coalesce(abs(epoch(try_strptime(gps_day || ' ' || substr(gps_time, 1, 8), '%Y:%m:%d %H:%M:%S')) - epoch(val)) <= 5, false) gps FROM x),
hh AS (SELECT *, list_filter(range(-28, 29), lambda n: n <> 0 AND (abs(n * 1800 - (epoch(dev) - epoch(val))) <= 3 OR coalesce(abs(n * 1800 - (epoch(dev) - epoch(val)) - dur) <= 3, false))) hits FROM y),
mm AS (SELECT *, CASE WHEN vid THEN CASE WHEN zm IS NOT NULL THEN zm WHEN len(hits) = 1 THEN hits[1] * 30 END END mins FROM hh),
z AS (SELECT *, CASE WHEN zm IS NOT NULL THEN val + INTERVAL 1 MINUTE * zm ELSE dev END loc, CASE WHEN gps THEN 'GPSDateStamp+' ELSE '' END || CASE WHEN zm IS NOT NULL THEN 'TimeZone' ELSE dn END evid,
 CASE WHEN val IS NOT NULL THEN CASE WHEN mins IS NOT NULL THEN 'inferred_local' ELSE 'exif' END WHEN taken_at IS NOT NULL THEN 'takeout' WHEN fd IS NOT NULL THEN 'filename'
 WHEN list_contains(bad, 'future') THEN 'rejected_future' WHEN list_contains(bad, 'sentinel') THEN 'rejected_sentinel' WHEN list_contains(bad, 'early') THEN 'rejected_early' ELSE 'none' END src FROM mm)"""
TAGGED = "CASE WHEN mins IS NOT NULL THEN tg || '|' || evid || '|' || CASE WHEN mins < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(mins) // 60 AS STRING), 2, '0') || ':' || lpad(CAST(abs(mins) % 60 AS STRING), 2, '0') WHEN vid THEN tg || '|not_proven_utc' ELSE tg END"
CAP = "CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'takeout' THEN taken_at WHEN 'filename' THEN fd END"
query("f10_f11_resolve_capture", f"""WITH {DATED}, {EMBED}, {RESOLVED} SELECT id, src AS source, {CAP} AS value, CASE WHEN src IN ('inferred_local', 'exif') THEN {TAGGED} END AS tag FROM z""")(
    lambda t: dates.with_capture_datetime(t.media, _now(), taken="taken_at", out="r").select("id", "r.source", "r.value", "r.tag"))
# the export's own time first, and its upload time before the name
query("f10_prefer_sidecars", f"""WITH {DATED}, {EMBED}, {RESOLVED} SELECT id, CASE WHEN taken_at IS NOT NULL THEN 'takeout' WHEN val IS NOT NULL THEN src WHEN uploaded_at IS NOT NULL THEN 'takeout_upload' ELSE src END AS source,
 CASE WHEN taken_at IS NOT NULL THEN taken_at WHEN mins IS NOT NULL THEN loc WHEN val IS NOT NULL THEN val WHEN uploaded_at IS NOT NULL THEN uploaded_at ELSE fd END AS value, CASE WHEN taken_at IS NULL AND val IS NOT NULL THEN {TAGGED} END AS tag FROM z""")(
    lambda t: dates.with_capture_datetime(t.media, _now(), taken="taken_at", created="uploaded_at", prefer_takeout=True, out="r").select("id", "r.source", "r.value", "r.tag"))
query("f7_f8_date_quality", f"""WITH {DATED}, {EMBED}, {RESOLVED} SELECT count(*) AS files, count(*) FILTER (src = 'rejected_sentinel') AS sentinel_rejected, count(*) FILTER (src = 'rejected_future') AS future_rejected,
 count(*) FILTER (src IN ('exif', 'takeout', 'inferred_local') AND CASE src WHEN 'exif' THEN val WHEN 'takeout' THEN taken_at END IN (TIMESTAMP '2000-01-01', TIMESTAMP '1999-12-31', TIMESTAMP '1980-01-01')) AS suspect FROM z""")(
    lambda t: pipelines.date_quality(dates.with_capture_datetime(t.media, _now(), taken="taken_at", out="r")))
query("f12_parse_duration", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_suppkey * 3600 + l_partkey % 60 * 60 + l_orderkey % 60 WHEN 1 THEN l_partkey % 60 * 60 + l_orderkey % 60 + 0.5 WHEN 2 THEN l_quantity END::DOUBLE AS seconds FROM lineitem")(
    lambda t: t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_linenumber % 4 WHEN 0 THEN CAST(l_suppkey AS STRING) || ':' || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(l_orderkey % 60 AS STRING), 2, '0') WHEN 1 THEN CAST(l_partkey % 60 AS STRING) || ':' || lpad(CAST(l_orderkey % 60 AS STRING), 2, '0') || '.5' WHEN 2 THEN CAST(l_quantity AS STRING) || ' s' ELSE 'x' END AS d").select("l_orderkey", "l_linenumber", dates.parse_duration(F.col("d")).alias("seconds")))
query("f13_device_clock", f"WITH {DATED} SELECT id, CASE id % 14 WHEN 2 THEN date_trunc('day', od) + INTERVAL 12 HOUR WHEN 5 THEN date_trunc('day', od) + INTERVAL '10:11:12' HOUR TO SECOND END AS local, CASE id % 14 WHEN 2 THEN 'filename:IMG_' WHEN 5 THEN 'filename:VID_' END AS evidence FROM d".replace("INTERVAL '10:11:12' HOUR TO SECOND", "INTERVAL 36672 SECOND"))(
    lambda t: t.media.select("id", dates.device_filename_local(F.col("name")).alias("d")).select("id", "d.local", "d.evidence"))
query("f14_date_tags", """SELECT DISTINCT date_tag, split_part(date_tag, '|', 1) AS container, split_part(date_tag, '|', 2) AS evidence, CASE date_tag[-6:] WHEN '+02:00' THEN 120 WHEN '-03:30' THEN -210 WHEN '+05:45' THEN 345 END AS minutes,
 CASE WHEN date_tag NOT LIKE '%not_proven%' THEN date_tag[-6:] END AS again FROM files WHERE date_tag LIKE '%|%'""")(
    lambda t: t.files.select("date_tag", dates.parse_date_tag(F.col("date_tag")).alias("p")).where("p IS NOT NULL").select("date_tag", "p.*").withColumn("again", dates.format_offset(F.col("minutes"))).distinct())
query("f16_dated_filename", """SELECT sha256, CASE WHEN captured_at IS NULL OR contains(original_name, strftime(captured_at, '%Y%m%d_%H%M%S')) THEN original_name ELSE strftime(captured_at, '%Y%m%d_%H%M%S') || '_' || original_name END AS name FROM files""")(
    lambda t: t.files.select("sha256", paths.dated_filename(F.col("original_name"), F.col("captured_at"), F.lit(True)).alias("name")))
query("f17_slugify", r"SELECT p_partkey, trim(substr(trim(regexp_replace(lower(trim(p_name || '! & Co')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') AS slug FROM part")(lambda t: t.raw("part").select("p_partkey", paths.slugify(F.concat("p_name", F.lit("! & Co"))).alias("slug")))
query("f18_event_folder", r"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') || '_goa' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' - Trip_ ' || CAST(o_custkey AS STRING) END AS folder FROM orders")(
    lambda t: t.raw("orders").select("o_orderkey", paths.event_folder(F.col("o_orderdate"), F.lit("goa"), F.when(F.col("o_orderkey") % 3 == 0, "///").otherwise(F.concat(F.lit("Trip: "), F.col("o_custkey").cast("string"), F.lit(". "))), composed=True).alias("folder")))
query("f19_sanitize_value", r"""WITH c AS (SELECT doc_id, nfc_normalize(rtrim(trim(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), ' .')) v FROM documents)
SELECT doc_id, rtrim(trim(substr(v, 1, list_max(list_filter(range(0, 256), lambda n: strlen(substr(v, 1, n)) <= 255)))), ' .') AS value FROM c""")(
    lambda t: t.raw("documents").select("doc_id", paths.sanitize_value(F.col("text")).alias("value")))
FOLDER = "CASE WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m/%Y-%m - Everyday') END"
query("f20_render_path", f"SELECT sha256, {FOLDER} AS folder FROM files")(lambda t: t.files.select("sha256", paths.render_path(paths.EVERYDAY_TEMPLATE, F.col("captured_at"), F.col("category"), composed=True).alias("folder")))
query("f21_f22_placement", f"""SELECT sha256, CASE WHEN category <> 'Camera' THEN 'side_bin' WHEN size % 5 = 0 THEN 'trip_day' WHEN event_id IS NOT NULL THEN 'event_day' WHEN size % 3 = 0 THEN 'day_bucket' ELSE 'everyday' END AS placement,
 CASE WHEN category <> 'Camera' THEN category || '/' || CASE WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m') END WHEN size % 5 = 0 THEN CASE WHEN captured_at IS NULL THEN 'Undated/T' ELSE strftime(captured_at, '%Y/%Y-%m') || '/T/' || strftime(captured_at, '%Y-%m-%d') END
 WHEN event_id IS NOT NULL THEN CASE WHEN captured_at IS NULL THEN 'Undated/E' ELSE strftime(captured_at, '%Y/%Y-%m') || '/E' END WHEN size % 3 = 0 THEN CASE WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m/%Y-%m-%d - Everyday') END ELSE {FOLDER} END AS folder FROM files""")(lambda t: _placed(t))


def _placed(t):
    rule = F.when(F.col("category") == "Camera", "device").otherwise("fallback")
    event, trip = F.when(F.col("event_id").isNotNull(), "E"), F.when(F.col("size") % 5 == 0, "T")
    place = paths.classify_placement(rule, trip, event, F.col("size") % 3 == 0)
    return t.files.select("sha256", place.alias("placement"), paths.DEFAULT_PRESET.folder(place, F.col("captured_at"), F.col("category"), event, trip, composed=True).alias("folder"))


# a folder of the month, of the day, of an event, and none, by each file's own date, against one of them
MOVES = """SELECT sha256, CASE size % 4 WHEN 0 THEN date_format(captured_at, 'yyyy/yyyy-MM/yyyy-MM') || ' - Everyday' WHEN 1 THEN date_format(captured_at, 'yyyy/yyyy-MM/yyyy-MM-dd') || ' - Everyday' WHEN 2 THEN date_format(captured_at, 'yyyy/yyyy-MM-dd') || ' - Trip' ELSE category END || '/' || original_name AS o,
 replace(CASE size % 3 WHEN 0 THEN date_format(captured_at, 'yyyy/yyyy-MM/yyyy-MM-dd') || ' - Everyday' WHEN 1 THEN date_format(captured_at, 'yyyy/yyyy-MM/yyyy-MM') || ' - Everyday' ELSE category END, '/', CASE WHEN size % 5 = 0 THEN chr(92) ELSE '/' END) || '/' || original_name AS n FROM {files}"""
query("f23_axis_changed", "SELECT sha256, CASE WHEN captured_at IS NULL THEN NULL WHEN size % 4 = 0 AND size % 3 = 0 THEN true WHEN size % 4 = 1 AND size % 3 = 1 THEN false END AS axis FROM files")(
    lambda t: t.spark.sql(MOVES, files=t.files).select("sha256", paths.everyday_axis_changed(F.col("o"), F.col("n")).alias("axis")))
query("f24_haversine", """SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(pow(sin((radians(b) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin((radians(d) - radians(c)) / 2), 2))), 6) AS km
 FROM (SELECT c_custkey, c_custkey % 80 a, c_nationkey * 3 b, c_custkey % 170 c, c_nationkey d FROM customer)""")(
    lambda t: t.raw("customer").select("c_custkey", F.round(measures.haversine_km(F.col("c_custkey") % 80, F.col("c_custkey") % 170, F.col("c_nationkey") * 3, F.col("c_nationkey")), 6).alias("km")))
query("f25_hamming", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INT AS distance FROM orders")(lambda t: t.raw("orders").select("o_orderkey", measures.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("distance")))
# a part's name in wrappers, with a possessive, a date before it, separators, and a year of two or four digits behind it
query("f26_tidy", """WITH y AS (SELECT *, 1970 + p_partkey % 60 AS year FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' Wedding' WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN p_name || ' (' || CAST(year + 1 AS STRING) || ')' WHEN 4 THEN p_name || ' day' ELSE p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING) || 'x' END AS name FROM y""")(
    lambda t: t.raw("part").selectExpr("p_partkey", "1970 + p_partkey % 60 AS year", """CASE p_partkey % 6 WHEN 0 THEN '(' || upper(p_name) || "'s Wedding)" WHEN 1 THEN CAST(1970 + p_partkey % 60 AS STRING) || '-0' || CAST(1 + p_size % 9 AS STRING) || '-1 ' || p_name || ' ' || substr(CAST(1970 + p_partkey % 60 AS STRING), 3)
  WHEN 2 THEN p_name || ' (' || CAST(1970 + p_partkey % 60 AS STRING) || ')' WHEN 3 THEN p_name || ' (' || CAST(1971 + p_partkey % 60 AS STRING) || ')~~' WHEN 4 THEN replace(p_name, ' ', '~~') || '_day!' ELSE '  ' || p_brand || '|' || p_name || ' · ' || CAST(p_size AS STRING) || 'x ' END AS n""").select("p_partkey", paths.strip_year(paths.tidy_folder(F.col("n")), F.col("year")).alias("name")))
query("f27_upright_size", "SELECT id, CASE WHEN id % 9 BETWEEN 5 AND 8 OR id % 5 IN (1, 3) THEN height ELSE width END AS w, CASE WHEN id % 9 BETWEEN 5 AND 8 OR id % 5 IN (1, 3) THEN width ELSE height END AS h FROM media")(
    lambda t: t.media.select("id", measures.upright_size(F.col("width"), F.col("height"), F.col("id") % 9, F.col("id") % 5).alias("s")).select("id", F.col("s.width").alias("w"), F.col("s.height").alias("h")))
query("f28_explain_source", f"""SELECT date_source, date_tag, count(*) AS files, CASE date_source WHEN 'exif' THEN 'Embedded in the file' WHEN 'takeout' THEN 'Export sidecar' WHEN 'filename' THEN 'File name' WHEN 'inferred_local' THEN 'Shifted to local time' ELSE 'Not recorded' END AS label,
 coalesce(date_source = 'filename', false) AS review, {SENTENCE} AS evidence FROM files GROUP BY 1, 2""")(
    lambda t: t.files.groupBy("date_source", "date_tag").agg(F.count("*").alias("files")).withColumn("x", dates.explain_source(F.col("date_source"))).select("date_source", "date_tag", "files", "x.label", "x.review", dates.explain_evidence(F.col("date_source"), F.col("date_tag")).alias("evidence")))
query("c17_review_predicates", f"WITH {SHOTS} SELECT path, bucket <> 'exact' AS should_upload, bucket = 'unique' OR bucket = 'unreadable' AND cs.path IS NULL AS is_unique FROM ks LEFT JOIN cs USING (path)")(
    lambda t: duplicates.resolve(t.shots.where("part = 0"), t.shots.where("part > 0")).select("path", origin.should_upload(F.col("kind")).alias("should_upload"), origin.is_unique(F.col("kind")).alias("is_unique")))
query("f15_local_naive", "SELECT id, taken_at + INTERVAL 1 MINUTE * (CASE WHEN id % 3 = 0 THEN 0 ELSE (id % 27 - 13) * 30 END) AS local FROM media WHERE taken_at IS NOT NULL")(
    lambda t: t.media.where("taken_at IS NOT NULL").select("id", dates.local_naive(F.col("taken_at"), F.when(F.col("id") % 3 > 0, (F.col("id") % 27 - 13) * 30)).alias("local")))
query("f31_geo_point", "SELECT id, CASE WHEN id % 3 > 0 AND id % 4 > 0 THEN (id % 181 - 90)::DOUBLE END AS lat, CASE WHEN id % 3 > 0 AND id % 4 > 0 THEN id % 360 - 179.5 END::DOUBLE AS lon FROM media")(
    lambda t: t.media.selectExpr("id", "CASE WHEN id % 3 > 0 THEN CAST(id % 181 - 90 AS STRING) ELSE 'x' END AS a", "CASE WHEN id % 4 > 0 THEN CAST(id % 360 - 179.5 AS STRING) END AS b").select("id", measures.geo_point(F.col("a"), F.col("b")).alias("g")).select("id", "g.lat", "g.lon"))
query("f33_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(lambda t: t.raw("documents").select("doc_id", measures.content_hash(F.col("text")).alias("sha256")))
EMB_SIG = "list_sum(list_transform(range(1, 64), lambda i: CASE WHEN {v}[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END)) + CASE WHEN {v}[64] > 0 THEN -9223372036854775808::HUGEINT ELSE 0 END"
query("f35_rebase", "SELECT sha256, CASE WHEN source_path LIKE '/src/4/%' THEN '/m/' || substr(source_path, 8) END AS new FROM files")(lambda t: t.files.select("sha256", paths.rebase(F.col("source_path"), "/src/4/", "/m").alias("new")))

# sidecars

MEDIA_NAMES = "CASE l_linenumber % 4 WHEN 0 THEN 'a' || CAST(l_partkey AS STRING) || '.jpg' WHEN 1 THEN 'a' || CAST(l_partkey AS STRING) || '-edited.jpg' WHEN 2 THEN 'a' || CAST(l_partkey AS STRING) || '(1).jpg' ELSE 'b.mp4' END"
SIDECAR_NAMES = "CASE l_linenumber % 3 WHEN 0 THEN 'a' || CAST(l_partkey AS STRING) || '.jpg.json' WHEN 1 THEN 'a' || CAST(l_partkey AS STRING) || '.jpg.supplemental-metada.json' ELSE 'a' || CAST(l_partkey AS STRING) || '.jpg(1).json' END"
query("j1_match_sidecars", f"""WITH m AS (SELECT DISTINCT CAST(l_orderkey % 50 AS STRING) AS folder, {MEDIA_NAMES} AS media FROM lineitem), s AS (SELECT DISTINCT CAST(l_orderkey % 50 AS STRING) AS folder, {SIDECAR_NAMES} AS name FROM lineitem),
b AS (SELECT *, replace(media, '-edited', '') base, CASE WHEN media LIKE '%(1).jpg' THEN replace(media, '(1).jpg', '.jpg(1)') END moved FROM m)
SELECT b.folder, media, coalesce(s1.name, s2.name, s3.name) AS sidecar FROM b LEFT JOIN s s1 ON s1.folder = b.folder AND s1.name = base || '.json' LEFT JOIN s s2 ON s2.folder = b.folder AND s2.name = moved || '.json' LEFT JOIN s s3 ON s3.folder = b.folder AND s3.name = base || '.supplemental-metada.json'""")(
    lambda t: sidecars.match_sidecars(t.raw("lineitem").selectExpr("CAST(l_orderkey % 50 AS STRING) AS folder", f"{MEDIA_NAMES} AS name").distinct(), t.raw("lineitem").selectExpr("CAST(l_orderkey % 50 AS STRING) AS folder", f"{SIDECAR_NAMES} AS name").distinct()))
query("s3_parse_sidecars", """SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN date_trunc('second', ts) END AS taken_at, CASE WHEN event_id % 10 = 9 OR event_id % 7 = 0 THEN NULL ELSE (event_id % 7)::DOUBLE END AS lat FROM events""")(lambda t: _sidecar_json(t))


def _sidecar_json(t):
    from lumibase.sources import parse_sidecars

    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    body = F.concat(F.lit('{"photoTakenTime":{"timestamp":"'), seconds, F.lit('"},"geoData":{"latitude":'), (F.col("event_id") % 7).cast("string"), F.lit('.0,"longitude":0.0},"description":" "}'))
    texts = t.raw("events").select(F.lit("f").alias("folder"), F.col("event_id").cast("string").alias("name"), F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(body).alias("content"))
    return parse_sidecars(texts).select(F.col("name").cast("bigint").alias("event_id"), "taken_at", "lat")


query("a16_albums", "SELECT sha256, array_to_string(list_sort(list_distinct(list(drive_uuid))), ',') AS albums FROM copies GROUP BY 1")(
    lambda t: sidecars.aggregate_albums(t.copies.select("sha256", F.col("drive_uuid").alias("album"))).select("sha256", F.array_join("albums", ",").alias("albums")))
query("j24_ingest_writes", """SELECT sha256 AS path, CASE WHEN date_source = 'takeout' THEN captured_at END AS write_date, CASE WHEN size % 3 > 0 THEN size % 90 END AS lat, CASE WHEN size % 5 = 0 THEN 'note' END AS write_description FROM files
 WHERE (date_source = 'takeout' AND captured_at IS NOT NULL) OR size % 3 > 0 OR size % 5 = 0""")(
    lambda t: sidecars.ingest_writes(t.files.selectExpr("sha256 AS path", "date_source", "captured_at AS taken_at", "size % 90 AS lat", "1 AS lon", "CASE WHEN size % 3 = 0 THEN 1 END AS embedded_lat", "CASE WHEN size % 5 = 0 THEN ' note ' ELSE ' ' END AS description")).select("path", "write_date", F.col("write_place.lat").alias("lat"), "write_description"))

# duplicates: the documents' first quarter as the catalog

query("a10_size_prefilter", "WITH k AS (SELECT DISTINCT size FROM docs WHERE part = 0), s AS (SELECT size, count(*) n FROM docs WHERE part > 0 GROUP BY 1) SELECT doc_id, s.n > 1 OR k.size IS NOT NULL AS needs_hash FROM docs JOIN s USING (size) LEFT JOIN k USING (size) WHERE part > 0")(
    lambda t: duplicates.size_prefilter(t.docs.where("part > 0"), t.docs.where("part = 0")).select("doc_id", "needs_hash"))
query("j2_exact_dedup", """WITH r AS (SELECT path, sha256, part, row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) n, first_value(path) OVER (PARTITION BY sha256 ORDER BY part > 0, path) p, first_value(part > 0) OVER (PARTITION BY sha256 ORDER BY part > 0, path) b FROM docs)
SELECT path, CASE WHEN n > 1 THEN 'exact' ELSE 'unique' END AS kind, CASE WHEN n > 1 THEN p END AS match_path, CASE WHEN n > 1 THEN CASE WHEN b THEN 'batch' ELSE 'catalog' END END AS match_origin FROM r WHERE part > 0""")(
    lambda t: duplicates.resolve(t.docs.where("part = 0"), t.docs.where("part > 0"), perceptual=False).select("path", "kind", "match_path", "match_origin"))
query("k1_resolve", """WITH r AS (SELECT *, part > 0 b, row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) n, first_value(path) OVER (PARTITION BY sha256 ORDER BY part > 0, path) p FROM docs),
u AS (SELECT path, b, perceptual FROM r WHERE n = 1),
c AS (SELECT x.path, min((bit_count(xor(x.perceptual, y.perceptual)), y.b, y.path)) m FROM u x JOIN u y ON (y.b, y.path) < (x.b, x.path) AND bit_count(xor(x.perceptual, y.perceptual)) <= 5 WHERE x.b GROUP BY 1)
SELECT r.path, CASE WHEN n > 1 THEN 'exact' WHEN m IS NOT NULL THEN 'near' ELSE 'unique' END AS kind, CASE WHEN n > 1 THEN p ELSE m[3] END AS match_path, CASE WHEN n = 1 THEN m[1]::INT END AS distance FROM r LEFT JOIN c USING (path) WHERE r.b""".replace("m[3]", "struct_extract(m, 3)").replace("m[1]", "struct_extract(m, 1)"))(
    lambda t: duplicates.resolve(t.docs.where("part = 0"), t.docs.where("part > 0")).select("path", "kind", "match_path", "distance"))
# the embeddings' signatures, and copies of each with one and with two bits flipped
SIGNATURES = f"WITH e AS (SELECT vec_id AS n, ({EMB_SIG.replace('{v}', 'embedding')})::BIGINT AS sig FROM embeddings), s AS (SELECT sig FROM e UNION SELECT xor(sig, 1::BIGINT << (n % 50)::INT) FROM e UNION SELECT xor(xor(sig, 1::BIGINT << (n % 40)::INT), 1::BIGINT << (n % 40 + 11)::INT) FROM e)"
query("j3_wide_links", SIGNATURES + " SELECT a.sig AS a, b.sig AS b, bit_count(xor(a.sig, b.sig))::INT AS distance FROM s a JOIN s b ON a.sig <> b.sig AND bit_count(xor(a.sig, b.sig)) <= 12")(lambda t: duplicates.signature_links(written(_signatures(t), "signatures"), 12))
query("f34_j3_embedding_links", SIGNATURES + " SELECT a.sig AS a, b.sig AS b, bit_count(xor(a.sig, b.sig))::INT AS distance FROM s a JOIN s b ON a.sig <> b.sig AND bit_count(xor(a.sig, b.sig)) <= 5")(lambda t: duplicates.signature_links(written(_signatures(t), "signatures"), 5))


def _signatures(t):
    own = t.raw("embeddings").select(F.col("vec_id").alias("n"), measures.signature64(F.col("embedding")).alias("perceptual"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    flip = lambda *bits: own.select(reduce(lambda x, b: x.bitwiseXOR(bit(b)), bits, F.col("perceptual")).alias("perceptual"))
    n = F.col("n")
    return own.select("perceptual").union(flip(n % 50)).union(flip(n % 40, n % 40 + 11)).distinct()


query("a11_forecast", """WITH s AS (SELECT size, count(*) n, count(*) FILTER (lower(split_part(original_name, '.', -1)) IN ('jpg', 'heic', 'png')) im, count(*) FILTER (lower(split_part(original_name, '.', -1)) = 'heic') sl FROM files GROUP BY 1),
a AS (SELECT sum(n)::BIGINT AS files, sum(n * size)::BIGINT AS bytes, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS colliding_files, coalesce(sum(n * size) FILTER (n > 1), 0)::BIGINT AS colliding_bytes, sum(im)::BIGINT AS images, sum(sl)::BIGINT AS slow_images FROM s)
SELECT *, round(colliding_bytes / bytes, 6) AS share, round(slow_images / images, 6) AS slow_share, round(slow_images / images, 6) >= 0.25 AS slow_look FROM a""")(lambda t: duplicates.forecast(t.files, F.col("original_name")))


def _resolved(t):
    found = duplicates.resolve(t.docs.where("part = 0"), t.docs.where("part > 0"))
    return found.join(t.docs.select("path", "size", F.element_at(F.split("path", "/"), 3).alias("category"), F.expr("CASE WHEN size % 4 = 0 THEN NULL ELSE DATE'2020-01-01' END").alias("captured_at")), "path")


KIND = """r AS (SELECT *, part > 0 b, row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) n, first_value(part > 0) OVER (PARTITION BY sha256 ORDER BY part > 0, path) fb FROM docs), u AS (SELECT path, b, perceptual FROM r WHERE n = 1),
c AS (SELECT DISTINCT x.path FROM u x JOIN u y ON (y.b, y.path) < (x.b, x.path) AND bit_count(xor(x.perceptual, y.perceptual)) <= 5 WHERE x.b),
k AS (SELECT r.*, split_part(r.path, '/', 3) category, CASE WHEN n > 1 THEN 'exact' WHEN c.path IS NOT NULL THEN 'near' ELSE 'unique' END kind FROM r LEFT JOIN c USING (path) WHERE r.b)"""
query("a12_duplicate_bytes", f"WITH {KIND} SELECT count(*) FILTER (kind = 'exact') AS exact_files, coalesce(sum(size) FILTER (kind = 'exact'), 0)::BIGINT AS reclaimable_bytes, count(*) FILTER (kind = 'near') AS near_files, coalesce(sum(size) FILTER (kind = 'near'), 0)::BIGINT AS near_bytes FROM k")(
    lambda t: duplicates.duplicate_bytes(_resolved(t)))
query("a13_report_buckets", f"WITH {KIND} SELECT kind AS bucket, count(*) AS files, count(*) FILTER (kind <> 'exact' AND size % 4 <> 0) AS will_organize FROM k GROUP BY 1")(lambda t: duplicates.report_buckets(_resolved(t), skip_undated=True))
query("a15_split_by_origin", f"WITH {KIND} SELECT CASE WHEN fb THEN 'batch' ELSE 'catalog' END AS origin, count(*) AS files FROM k WHERE kind = 'exact' GROUP BY 1")(lambda t: duplicates.split_by_origin(_resolved(t)))
query("a29_planned_actions", f"WITH {KIND} SELECT CASE WHEN kind = 'exact' THEN 'duplicate' WHEN size % 4 = 0 THEN 'skipped_undated' ELSE 'planned' END AS action, category, count(*) AS files FROM k GROUP BY 1, 2")(lambda t: duplicates.planned_actions(_resolved(t), skip_undated=True))
def _preview(t):
    batch = t.media.select("id", "name", "tags", "taken_at").join(t.shots.where("part > 0").drop("part"), "id")
    held = timeline.unevented(t.files, t.raw("events").where("user_id % 5 = 0").select(F.to_date("ts").alias("day")))
    return pipelines.preview(t.shots.where("part = 0"), batch, _now(), taken="taken_at", skip_undated=True, unevented=held, day_threshold=HEAVY)


#: Files of a day above which it is heavy, for tables whose days have few.
HEAVY = 3


query("j4_scope_to_destination", """WITH r AS (SELECT path, sha256, part > 0 b, row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) n, first_value(path) OVER (PARTITION BY sha256 ORDER BY part > 0, path) p, first_value(part > 0) OVER (PARTITION BY sha256 ORDER BY part > 0, path) fb FROM docs),
h AS (SELECT DISTINCT sha256, 'd/' || sha256 held FROM docs WHERE part = 0 AND size % 2 = 0)
SELECT path, CASE WHEN n > 1 AND (fb OR held IS NOT NULL) THEN 'exact' WHEN n = 1 THEN 'unique' END AS kind, CASE WHEN n > 1 THEN CASE WHEN fb THEN p ELSE held END END AS match_path FROM r LEFT JOIN h USING (sha256) WHERE b""")(
    lambda t: duplicates.scope_to_destination(duplicates.resolve(t.docs.where("part = 0"), t.docs.where("part > 0"), perceptual=False), t.docs.where("part = 0 AND size % 2 = 0").select("sha256", F.concat(F.lit("d/"), "sha256").alias("relative"), F.lit("x").alias("drive_uuid")), "x").select("path", "kind", "match_path"))

# timeline

SEGMENTS = """g AS (SELECT *, epoch(lead(captured_at) OVER w) - epoch(captured_at) gap, lead(lat) OVER w nlat, lead(lon) OVER w nlon FROM items WINDOW w AS (PARTITION BY library ORDER BY captured_at, sha256)),
l AS (SELECT *, CASE WHEN gap IS NOT NULL THEN ln(1 + greatest(gap, 0)) END lg, 2 * 6371.0088 * asin(sqrt(pow(sin((radians(nlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(nlat)) * pow(sin((radians(nlon) - radians(lon)) / 2), 2))) km FROM g),
md AS (SELECT *, median(lg) OVER (PARTITION BY library ORDER BY captured_at, sha256 ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING EXCLUDE CURRENT ROW) m FROM l),
e AS (SELECT *, CASE WHEN gap > 172800 OR (gap >= 3600 AND m IS NOT NULL AND lg - m > 4.0) OR coalesce(km > 50, false) THEN 1 ELSE 0 END ends FROM md),
s AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY library ORDER BY captured_at, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT segment FROM e),
ev AS (SELECT library, segment, count(*) files, min(captured_at) AS "start", max(captured_at) AS "end", round(avg(lat), 6) lat, round(avg(lon), 6) lon, sha256(array_to_string(list_sort(list(sha256)), chr(10))) signature FROM s GROUP BY 1, 2 HAVING count(*) >= 8)"""
query("w1_cluster_events", f'WITH {SEGMENTS} SELECT library, segment, files, "start", "end", lat, lon, signature FROM ev')(
    lambda t: timeline.cluster_events(t.items).select("library", "segment", "files", "start", "end", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "signature"))
TRIPS = """ad AS (SELECT DISTINCT library, CAST("start" AS DATE) AS day FROM ev), dc AS (SELECT library, CAST(captured_at AS DATE) AS day, count(*) n FROM items GROUP BY 1, 2), dd AS (SELECT * FROM ad JOIN dc USING (library, day)),
nn AS (SELECT *, CASE WHEN lag(day) OVER w IS NULL OR day - lag(day) OVER w - 1 > 1 OR year(day) <> year(lag(day) OVER w) THEN 1 ELSE 0 END nw FROM dd WINDOW w AS (PARTITION BY library ORDER BY day)),
rr AS (SELECT *, sum(nw) OVER (PARTITION BY library ORDER BY day) run FROM nn),
tr AS (SELECT library, min(day) start_date, max(day) end_date, count(*) active_days, sum(n)::BIGINT files, CASE WHEN max(day) - min(day) + 1 > 30 THEN 'declined_span' ELSE 'proposed' END outcome FROM rr GROUP BY library, run HAVING count(*) >= 2)"""
query("w2_detect_trips", f"WITH {SEGMENTS}, {TRIPS} SELECT * FROM tr")(lambda t: timeline.detect_trips(t.items, timeline.cluster_events(t.items)).drop("days"))
CARDS = """cl AS (SELECT DISTINCT tr.library, rr.day FROM tr JOIN rr ON rr.library = tr.library AND rr.day BETWEEN start_date AND end_date WHERE outcome = 'proposed'), tot AS (SELECT library, CAST(captured_at AS DATE) AS first_day, count(*) AS day_total FROM items GROUP BY 1, 2),
ca AS (SELECT library, 'trip' AS kind, start_date AS first_day, end_date AS last_day, files, NULL AS signature FROM tr WHERE outcome = 'proposed' UNION ALL SELECT ev.library, 'event', CAST("start" AS DATE), CAST("end" AS DATE), files, signature FROM ev {skip} ANTI JOIN cl ON cl.library = ev.library AND cl.day = CAST(ev."start" AS DATE))"""
query("w7_review_cards", f"""WITH {SEGMENTS}, {TRIPS}, {CARDS.replace("{skip}", "")} SELECT ca.*, day_total FROM ca JOIN tot USING (library, first_day)""")(lambda t: _cards(t).drop("name"))


def _cards(t):
    events = written(timeline.cluster_events(t.items), "events")  # trips, claims and cards are all made from the events
    return timeline.review_cards(timeline.detect_trips(t.items, events), events, t.items)


NAMED = """nm AS (SELECT signature, 'Event ' || CAST(library AS STRING) AS event_name FROM ev WHERE segment % 2 = 0), sk AS (SELECT signature FROM ev WHERE segment % 5 = 4),
cd AS (SELECT DISTINCT library, CAST(captured_at AS DATE) AS day, 'T' || CAST(library AS STRING) || '-' || CAST(day(captured_at) AS STRING) AS name FROM items WHERE library % 3 = 0 AND day(captured_at) % 2 = 0)"""
query("k7_trip_review", f"""WITH {SEGMENTS}, {TRIPS}, {NAMED}, {CARDS.replace("{skip}", "ANTI JOIN sk USING (signature)")},
tn AS (SELECT tr.library, start_date AS first_day, arg_min(cd.name, cd.day) AS trip_name FROM tr JOIN rr ON rr.library = tr.library AND rr.day BETWEEN start_date AND end_date JOIN cd ON cd.library = tr.library AND cd.day = rr.day GROUP BY 1, 2),
mb AS (SELECT ca.library, ca.kind, ca.first_day, ca.signature, count(*) n, count(*) FILTER (i.key % 5 <> 0) t FROM ca JOIN items i ON i.library = ca.library AND CAST(i.captured_at AS DATE) BETWEEN ca.first_day AND ca.last_day GROUP BY ALL)
SELECT ca.library, ca.kind, ca.first_day, ca.last_day, ca.files, day_total, coalesce(event_name, trip_name) AS name, CASE WHEN t >= 0.7 * n THEN 'Trip' || CAST(ca.library % 7 AS STRING) END AS suggestion
 FROM ca JOIN tot USING (library, first_day) LEFT JOIN nm USING (signature) LEFT JOIN tn ON tn.library = ca.library AND tn.first_day = ca.first_day AND ca.kind = 'trip'
 JOIN mb ON mb.library = ca.library AND mb.kind = ca.kind AND mb.first_day = ca.first_day AND mb.signature IS NOT DISTINCT FROM ca.signature""")(lambda t: _review(t))


def _review(t):
    events = written(timeline.cluster_events(t.items), "events")  # names and skips are made from the events themselves
    names = events.where("segment % 2 = 0").select("signature", F.concat(F.lit("Event "), F.col("library").cast("string")).alias("name"))
    return pipelines.trip_review(t.items, events, names, events.where("segment % 5 = 4"), _claimed(t))


def _claimed(t):
    return t.items.where("library % 3 = 0 AND day(captured_at) % 2 = 0").select("library", F.to_date("captured_at").alias("day"), F.expr("'T' || CAST(library AS STRING) || '-' || CAST(day(captured_at) AS STRING)").alias("name")).distinct()


query("a17_heavy_days", "SELECT CAST(captured_at AS DATE) AS day, count(*) AS files FROM items WHERE event_id IS NULL GROUP BY 1 HAVING count(*) > 40")(lambda t: timeline.heavy_days(timeline.capture_day_counts(t.items)))
query("j14_unevented", "SELECT sha256, captured_at FROM files WHERE category = 'Camera' AND captured_at IS NOT NULL AND event_id IS NULL AND CAST(captured_at AS DATE) NOT IN (SELECT CAST(captured_at AS DATE) FROM files WHERE size % 97 = 0 AND captured_at IS NOT NULL)")(
    lambda t: timeline.unevented(t.files, t.files.where("size % 97 = 0 AND captured_at IS NOT NULL").select(F.to_date("captured_at").alias("day"))).select("sha256", "captured_at"))
query("j15_named_overlay", f"WITH {SEGMENTS} SELECT library, signature, CASE WHEN segment % 2 = 0 THEN 'Event ' || CAST(library AS STRING) END AS name FROM ev WHERE segment % 5 <> 4")(lambda t: _overlay(t))


def _overlay(t):
    events = written(timeline.cluster_events(t.items), "events")
    names = events.where("segment % 2 = 0").select("signature", F.concat(F.lit("Event "), F.col("library").cast("string")).alias("name"))
    return timeline.named_overlay(events, names, events.where("segment % 5 = 4")).select("library", "signature", "name")


query("w3_disambiguate_folders", """SELECT key, CASE WHEN n > 1 THEN folder || ' (' || CAST(n AS STRING) || ')' ELSE folder END AS folder FROM (SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS folder, row_number() OVER (PARTITION BY lower(event_type) ORDER BY ts, event_id) n FROM events)""")(
    lambda t: timeline.disambiguate_folders(t.raw("events").selectExpr("event_id AS key", "ts AS start", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS folder")).select("key", "folder"))
query("w8_merge_cards", """WITH e AS (SELECT user_id AS library, CAST(ts AS DATE) AS day, CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / (8 + user_id % 20)) AS BIGINT) AS merge, event_type FROM events),
k AS (SELECT library, merge, event_type, min(day) AS a, max(day) AS b FROM e GROUP BY ALL), c AS (SELECT library, day, count(*) n FROM e GROUP BY ALL), d AS (SELECT DISTINCT k.library, merge, day, n FROM k JOIN c ON c.library = k.library AND day BETWEEN a AND b),
s AS (SELECT library, merge, min(a) AS first_day, max(b) AS last_day FROM k GROUP BY ALL)
SELECT library, merge, first_day, last_day, sum(n)::BIGINT AS files, CASE WHEN year(first_day) <> year(last_day) THEN 'crosses_year' WHEN last_day - first_day + 1 > 20 THEN 'over_span' END AS error FROM s JOIN d USING (library, merge) GROUP BY ALL""")(
    lambda t: timeline.merge_cards(
        t.raw("events").selectExpr("user_id AS library", "CAST(floor(datediff(ts, DATE '2024-01-01') / (8 + user_id % 20)) AS BIGINT) AS merge", "event_type", "CAST(ts AS DATE) AS day").groupBy("library", "merge", "event_type").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")),
        t.raw("events").groupBy(F.col("user_id").alias("library"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), 20))
query("w9_commit_events", """SELECT o_orderkey AS signature, CASE WHEN o_orderkey % 5 = 0 THEN 'link' WHEN o_orderkey % 3 > 0 THEN 'create' WHEN o_orderkey % 2 = 0 THEN 'nothing' ELSE 'skip' END AS action,
 CASE WHEN o_orderkey % 5 = 0 THEN 'held' WHEN o_orderkey % 3 > 0 THEN 'Name ' || CAST(o_custkey AS STRING) END AS name FROM orders""")(
    lambda t: timeline.commit_events(t.raw("orders").selectExpr("o_orderkey AS signature", "CASE WHEN o_orderkey % 3 > 0 THEN ' Name ' || CAST(o_custkey AS STRING) ELSE ' ' END AS name"),
        t.raw("orders").where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS signature", "'held' AS name"), t.raw("orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS signature")))
query("w8_split_card", "SELECT user_id AS library, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'first' ELSE 'second' END AS side, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(*) AS files FROM events GROUP BY 1, 2")(
    lambda t: timeline.split_card(t.raw("events").groupBy(F.col("user_id").alias("library"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "2024-01-15"))
query("w9_commit_trips", """WITH d AS (SELECT o_custkey AS decision, CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT CAST(o_orderdate AS DATE) AS day, min(o_custkey % 5) AS trip_id FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1),
j AS (SELECT decision, count(*) AS days, count(trip_id) cl, count(DISTINCT trip_id) tr, min(trip_id) one FROM d LEFT JOIN c USING (day) GROUP BY 1)
SELECT decision, days, CASE WHEN cl = 0 THEN 'create' WHEN cl = days AND tr = 1 THEN 'refresh' ELSE 'nothing' END AS action, CASE WHEN cl > 0 AND cl = days AND tr = 1 THEN one END AS trip_id FROM j""")(
    lambda t: timeline.commit_trips(t.raw("orders").select(F.col("o_custkey").alias("decision"), F.to_date("o_orderdate").alias("day")), t.raw("orders").where("o_orderkey % 7 = 0").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min(F.col("o_custkey") % 5).alias("trip_id"))))
query("w11_preview_warnings", "SELECT path, count(*) OVER (PARTITION BY lower(path)) > 1 AS collides, length(path) > 200 AS long FROM (SELECT CASE WHEN size % 2 = 0 THEN 'A' ELSE 'a' END || CAST(size % 9000 AS STRING) AS path FROM files)")(
    lambda t: on_drives.preview_warnings(t.files.selectExpr("CASE WHEN size % 2 = 0 THEN 'A' ELSE 'a' END || CAST(size % 9000 AS STRING) AS path")))
query("w12_suffix_max", "SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS largest_left FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) l_quantity FROM lineitem GROUP BY 1, 2)")(
    lambda t: timeline.suffix_max(t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")), "l_orderkey", "l_linenumber", "q").select("l_orderkey", "l_linenumber", "largest_left"))
query("w14_stride_sample", "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events) SELECT user_id, event_id FROM s WHERE n <= 5 OR (i * 5 + n - 1) // n * n // 5 = i")(
    lambda t: timeline.stride_sample(t.raw("events").select("user_id", "event_id"), "user_id", "event_id", 5))
query("j22_stills_corroborate", """WITH v AS (SELECT user_id AS library, event_id AS key, ts AS local FROM events WHERE event_type = 'error'), s AS (SELECT user_id AS library, ts FROM events WHERE event_type = 'view' AND user_id % 4 > 0)
SELECT v.library, v.key, v.local, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.library = v.library) THEN EXISTS (SELECT 1 FROM s WHERE s.library = v.library AND abs(floor(epoch(s.ts)) - floor(epoch(v.local))) <= 7200) END AS corroborated FROM v""")(
    lambda t: timeline.stills_corroborate(t.raw("events").where("event_type = 'error'").selectExpr("user_id AS library", "event_id AS key", "ts AS local"), t.raw("events").where("event_type = 'view' AND user_id % 4 > 0").selectExpr("user_id AS library", "ts AS captured_at"), 120))
query("a26_a27_folder_suggestions", """WITH s AS (SELECT user_id AS cluster, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'Trip' || CAST(user_id % 7 AS STRING) END nm FROM events), z AS (SELECT cluster, count(*) m FROM s GROUP BY 1), c AS (SELECT cluster, nm, count(*) n FROM s WHERE nm IS NOT NULL GROUP BY 1, 2)
SELECT cluster, nm AS suggestion FROM c JOIN z USING (cluster) WHERE n >= 0.7 * m""")(
    lambda t: timeline.folder_suggestions(t.raw("events").selectExpr("user_id AS cluster", "'Home Place/' || CASE WHEN event_id % 5 = 0 THEN 'DCIM' ELSE 'Trip' || CAST(user_id % 7 AS STRING) END || '/a.jpg' AS path", "2024 AS year"), timeline.suggestion_roots(t.raw("events").selectExpr("user_id AS cluster", "'Home Place/a.jpg' AS path"))))

# migration


def _migration(t):
    events = t.raw("customer").selectExpr("c_custkey AS event_id", "c_name AS name", "timestamp_ntz'2001-02-03 00:00:00' AS start")
    trip_days = t.files.where("size % 89 = 0 AND captured_at IS NOT NULL").select(F.to_date("captured_at").alias("day")).distinct().withColumn("trip_id", F.lit(1))
    trips = t.spark.range(1).selectExpr("1 AS trip_id", "'Goa' AS name", "timestamp_ntz'1999-01-02 00:00:00' AS start")
    rows = on_drives.copies_for_migration(t.files, t.copies, "6", events, trip_days, trips)
    return on_drives.plan_migration(rows, t.files.where("size % 83 = 0").select(F.to_date("captured_at").alias("day")), composed=True)


query("j5_w10_plan_migration", """WITH td AS (SELECT DISTINCT CAST(captured_at AS DATE) AS day FROM files WHERE size % 89 = 0 AND captured_at IS NOT NULL), hd AS (SELECT DISTINCT CAST(captured_at AS DATE) AS day FROM files WHERE size % 83 = 0),
r AS (SELECT c.sha256, relative, f.*, c_name FROM copies c JOIN files f ON f.sha256 = c.sha256 LEFT JOIN customer ON c_custkey = event_id WHERE drive_uuid = '6'),
p AS (SELECT r.sha256, relative, CASE WHEN category <> 'Camera' THEN category || '/' || CASE WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m') END
 WHEN td.day IS NOT NULL THEN strftime(captured_at, '%Y/%Y-%m') || '/1999-01-02 - Goa/' || strftime(captured_at, '%Y-%m-%d')
 WHEN c_name IS NOT NULL THEN CASE WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m') END || '/2001-02-03 - ' || c_name
 WHEN hd.day IS NOT NULL THEN strftime(captured_at, '%Y/%Y-%m/%Y-%m-%d - Everyday') WHEN captured_at IS NULL THEN 'Undated' ELSE strftime(captured_at, '%Y/%Y-%m/%Y-%m - Everyday') END || '/' || original_name AS "new"
 FROM r LEFT JOIN td ON td.day = CAST(captured_at AS DATE) LEFT JOIN hd ON hd.day = CAST(captured_at AS DATE))
SELECT sha256, relative, "new", relative = "new" AS unchanged, count(*) OVER (PARTITION BY lower("new")) > 1 AS collides, length("new") > 200 AS long FROM p""")(lambda t: _migration(t).drop("axis"))
FILES_AS_MEDIA = "FROM (SELECT media.* REPLACE (original_name AS name), sha256, category FROM files JOIN media ON sha256 = CAST(id AS STRING) WHERE category NOT IN ('Screenshots', 'Saved'))"
query("j26_rederive", f"WITH {RULES.replace('FROM media', FILES_AS_MEDIA)} SELECT sha256, category, label, rule FROM c")(
    lambda t: on_drives.rederive(t.files, t.media.select(F.col("id").cast("string").alias("sha256"), "tags")))

# decisions: the events of four drives

SECTION = "sec AS (SELECT CAST(event_id % 4 AS STRING) AS drive_uuid, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS written, CAST(user_id AS STRING) || '-' || event_type AS key, CAST(value AS STRING) AS value, event_id FROM events)"


def _section(t):
    return t.raw("events").selectExpr("CAST(event_id % 4 AS STRING) AS drive_uuid", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS written", "CAST(user_id AS STRING) || '-' || event_type AS key", "CAST(event_id AS STRING) AS value", "event_id")


LATEST = "SELECT drive_uuid, key, CAST(event_id AS STRING) AS value, written, row_number() OVER (PARTITION BY key ORDER BY written DESC NULLS LAST, drive_uuid, CAST(event_id AS STRING)) n FROM sec"
query("w4_merge_section", f"WITH {SECTION}, r AS ({LATEST}) SELECT key, max(value) FILTER (n = 1) AS value, max(drive_uuid) FILTER (n = 1) AS drive_uuid, count(*) - 1 AS overruled FROM r GROUP BY key")(lambda t: decisions.merge_section(_section(t)))
query("w4_superseded", f"WITH {SECTION}, r AS ({LATEST}) SELECT r.drive_uuid, count(*) AS overruled FROM r JOIN r w ON w.key = r.key AND w.n = 1 WHERE r.value <> w.value GROUP BY 1")(lambda t: decisions.superseded(_section(t)))
#: Confirmations with ties in time; those of undated documents confirm that there is no date.
CONFIRMS = "cs AS (SELECT drive_uuid, written, key AS sha256, written AS captured_at, event_id // 16 AS confirmed_at, row_number() OVER (PARTITION BY key ORDER BY written DESC NULLS LAST, drive_uuid, written NULLS FIRST, event_id // 16) AS k FROM sec)"
query("w5_merge_confirmations", f"WITH {SECTION}, {CONFIRMS}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY confirmed_at DESC, written DESC NULLS LAST, drive_uuid, captured_at NULLS FIRST) n FROM cs) SELECT sha256, captured_at, confirmed_at FROM r WHERE n = 1")(lambda t: decisions.merge_confirmations(_confirms(t)))
query("w5_superseded", f"""WITH {SECTION}, {CONFIRMS}, p AS (SELECT b.*, a.drive_uuid AS d2, a.confirmed_at AS c2, a.captured_at AS t2, row_number() OVER (PARTITION BY b.sha256, b.k ORDER BY a.confirmed_at DESC, a.k) AS n FROM cs b JOIN cs a ON a.sha256 = b.sha256 AND a.k < b.k)
SELECT CASE WHEN confirmed_at > c2 THEN d2 ELSE drive_uuid END AS drive_uuid, count(*) AS overruled FROM p WHERE n = 1 AND (confirmed_at <> c2 OR captured_at IS DISTINCT FROM t2) GROUP BY 1""")(lambda t: decisions.superseded_confirmations(_confirms(t)))
query("w6_undated_documents", f"WITH {SECTION}, u AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'u' || drive_uuid ELSE drive_uuid END AS drive_uuid, written FROM sec) SELECT drive_uuid FROM u GROUP BY 1 HAVING count(written) = 0")(
    lambda t: decisions.undated_documents(_section(t).withColumn("drive_uuid", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("u"), "drive_uuid")).otherwise(F.col("drive_uuid")))))


def _confirms(t):
    return _section(t).selectExpr("drive_uuid", "written", "key AS sha256", "written AS captured_at", "event_id div 16 AS confirmed_at")


query("w6_merge_settings", f"WITH {SECTION}, r AS ({LATEST}) SELECT key, value, written IS NULL AS undated FROM r WHERE n = 1")(lambda t: decisions.merge_settings(_section(t)))
query("w6_merge_skips", f"WITH {SECTION} SELECT DISTINCT key AS signature FROM sec")(lambda t: decisions.merge_skips(_section(t)))
query("j28_restore_apply", f"""WITH {SECTION}, r AS ({LATEST}), m AS (SELECT * FROM r WHERE n = 1)
SELECT key, value AS theirs, CASE WHEN len(key) % 2 = 0 THEN CASE WHEN CAST(value AS BIGINT) % 3 = 0 THEN value ELSE 'old' END END AS ours,
 CASE WHEN key LIKE '1%' THEN 'awaiting_content' WHEN len(key) % 2 = 0 AND CAST(value AS BIGINT) % 3 = 0 THEN 'unchanged' WHEN len(key) % 2 = 0 AND written < TIMESTAMP '2024-01-29' THEN 'newer_locally' ELSE 'applied' END AS action FROM m""")(lambda t: _restore(t))


def _restore(t):
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.col("written").desc_nulls_last(), "drive_uuid", "value"))
    merged = _section(t).withColumn("n", rank).where("n = 1").select("key", "value", "written")
    current = merged.where("char_length(key) % 2 = 0").selectExpr("key", "CASE WHEN CAST(value AS BIGINT) % 3 = 0 THEN value ELSE 'old' END AS value", "timestamp_ntz'2024-01-29 00:00:00' AS updated")
    return decisions.restore_apply(merged, current, merged.where("key NOT LIKE '1%'"))


LOSE = "SELECT event_type AS section, user_id * 100 + day(ts) AS key FROM events WHERE event_id % 2 = {0} GROUP BY 1, 2"
query("j29_would_lose", f"SELECT section, count(*) AS keys FROM (({LOSE.format(0)}) EXCEPT ({LOSE.format(1)})) GROUP BY 1")(lambda t: decisions.would_lose(_keys(t, 0), _keys(t, 1)))
query("j32_decision_notice", f"WITH a AS (SELECT section, count(*) n FROM (({LOSE.format(0)}) EXCEPT ({LOSE.format(1)})) GROUP BY 1), b AS (SELECT section, count(*) n FROM (({LOSE.format(1)}) EXCEPT ({LOSE.format(0)})) GROUP BY 1) SELECT coalesce(a.section, b.section) AS section, coalesce(a.n, 0) AS to_restore, coalesce(b.n, 0) AS stale FROM a FULL JOIN b ON a.section = b.section")(
    lambda t: decisions.decision_notice(_keys(t, 0), _keys(t, 1)))


def _keys(t, part):
    return t.raw("events").where(F.col("event_id") % 2 == part).select(F.col("event_type").alias("section"), F.expr("user_id * 100 + day(ts)").alias("key"))


query("k6_library_stats", """WITH c AS (SELECT sha256, count(*) n, count(last_verified) v FROM copies GROUP BY 1), h AS (SELECT f.*, coalesce(n, 0) n, coalesce(v, 0) v FROM files f LEFT JOIN c USING (sha256)),
a AS (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (n >= 2) AS on_two_drives, count(*) FILTER (n = 1) AS on_one_drive, count(*) FILTER (n = 0) AS on_no_drive, count(*) FILTER (v = 0) AS never_verified, count(*) FILTER (captured_at IS NULL) AS undated,
 count(*) FILTER (captured_at IS NOT NULL AND category = 'Camera') AS timeline, count(*) FILTER (captured_at IS NULL OR category <> 'Camera') AS side_bin FROM h)
SELECT 'total' AS section, key, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME key VALUE value)
UNION ALL SELECT 'drive', label, count(c.sha256) FROM drives LEFT JOIN copies c ON uuid = drive_uuid GROUP BY uuid, label UNION ALL SELECT 'year', CAST(year(captured_at) AS STRING), count(*) FROM files WHERE captured_at IS NOT NULL GROUP BY 2
UNION ALL SELECT 'format', lower(split_part(original_name, '.', -1)), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'dates', date_source, count(*) FROM files GROUP BY 2
UNION ALL SELECT 'look_alike', NULL, coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) n FROM files WHERE perceptual IS NOT NULL GROUP BY perceptual HAVING count(*) > 1) UNION ALL SELECT 'on_no_drive', NULL, on_no_drive FROM a""")(lambda t: pipelines.library_stats(t.files, t.copies, t.drives))
CHECKED = "2005-01-01 00:00:00"
query("a28_library_status", f"""WITH x AS (SELECT lower(split_part(original_name, '.', -1)) ext, size FROM files), k AS (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (ext IN ('jpg', 'heic', 'png')) AS photos, count(*) FILTER (ext = 'mp4') AS videos, count(*) FILTER (ext = 'opus') AS audio FROM x),
p AS (SELECT count(DISTINCT drive_uuid) AS places FROM copies), o AS (SELECT count(*) AS single_copies FROM (SELECT sha256 FROM copies WHERE missing_at IS NULL GROUP BY 1 HAVING count(*) = 1)),
c AS (SELECT sha256, count(*) FILTER (missing_at IS NULL) n FROM copies GROUP BY 1), h AS (SELECT coalesce(n, 0) n FROM files LEFT JOIN c USING (sha256)),
f AS (SELECT count(*) FILTER (n = 0) AS no_copy, count(*) FILTER (n = 1) AS one_copy, min(n)::BIGINT AS floor, count(*) FILTER (n > 0) AS held, (min(n) FILTER (n > 0))::BIGINT AS held_floor, count(*) FILTER (n = (SELECT min(n) FROM h WHERE n > 0)) AS at_held_floor FROM h),
d AS (SELECT label, CASE WHEN count(*) = count(last_verified) THEN min(last_verified) END v FROM copies JOIN drives ON uuid = drive_uuid GROUP BY uuid, label),
g AS (SELECT count(*) FILTER (v IS NULL) AS never_checked, coalesce(string_agg(label, ';' ORDER BY label) FILTER (v IS NULL), '') AS never_checked_names, min(v) AS oldest_check, greatest(0, floor((epoch(TIMESTAMP '{CHECKED}') - epoch(min(v))) / 86400))::BIGINT AS age_days FROM d)
SELECT *, CASE WHEN age_days >= 90 THEN 'stale' WHEN age_days >= 30 THEN 'softening' ELSE 'fresh' END AS tier FROM k, p, o, f, g""")(lambda t: pipelines.library_status(t.files, t.copies, t.drives, CHECKED))
query("k3_analyze", f"""WITH {DATED}, {EMBED}, {RESOLVED}, w AS (SELECT z.id, z.name, src, CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'takeout' THEN z.taken_at WHEN 'filename' THEN fd END cap FROM z),
y2 AS (SELECT w.*, shots.size, shots.sha256, regexp_extract(lower(w.name), '[.]([^.]*)$', 1) ext FROM w JOIN shots USING (id)), sz AS (SELECT size, count(*) n FROM y2 GROUP BY 1)
SELECT count(*) AS files, sum(size)::BIGINT AS bytes, (SELECT coalesce(sum(n), 0) FROM sz WHERE n > 1)::BIGINT AS colliding_files, (SELECT coalesce(sum(n * size), 0) FROM sz WHERE n > 1)::BIGINT AS colliding_bytes,
 count(*) FILTER (ext IN ('jpg', 'png', 'heic', 'webp')) AS images, count(*) FILTER (ext = 'heic') AS slow_images, round((SELECT coalesce(sum(n * size), 0) FROM sz WHERE n > 1) / sum(size), 6)::DOUBLE AS share, round(count(*) FILTER (ext = 'heic') / count(*) FILTER (ext IN ('jpg', 'png', 'heic', 'webp')), 6) AS slow_share,
 round(count(*) FILTER (ext = 'heic') / count(*) FILTER (ext IN ('jpg', 'png', 'heic', 'webp')), 6) >= 0.25 AS slow_look, count(*) FILTER (ext IN ('jpg', 'png', 'heic', 'webp')) AS photos, count(*) FILTER (ext IN ('mp4', 'mov')) AS videos, 0::BIGINT AS audio, count(*) FILTER (cap IS NULL) AS undated, min(cap) AS earliest, max(cap) AS latest,
 count(*) FILTER (src = 'rejected_sentinel') AS sentinel_rejected, count(*) FILTER (src = 'rejected_future') AS future_rejected, count(*) FILTER (src IN ('exif', 'takeout', 'inferred_local') AND cap IN (TIMESTAMP '2000-01-01', TIMESTAMP '1999-12-31', TIMESTAMP '1980-01-01')) AS suspect,
 (SELECT sum(n - 1) FROM (SELECT count(*) n FROM y2 WHERE sha256 IS NOT NULL GROUP BY sha256))::BIGINT AS exact_files FROM y2""")(
    lambda t: pipelines.analyze(t.media.select("id", "name", "tags", "taken_at").join(t.shots.select("id", "size", "sha256"), "id"), _now(), taken="taken_at"))

# pipelines of the above

query("k2_plan", f"""WITH {RULES}, {DATED}, {EMBED}, {RESOLVED}, w AS (SELECT z.id, src, CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'takeout' THEN z.taken_at WHEN 'filename' THEN fd END cap FROM z)
SELECT c.id, label, cap AS captured_at, src AS source, CASE WHEN rule NOT IN ('device', 'camera_filename') THEN label || '/' || CASE WHEN cap IS NULL THEN 'Undated' ELSE strftime(cap, '%Y/%Y-%m') END WHEN cap IS NULL THEN 'Undated' ELSE strftime(cap, '%Y/%Y-%m/%Y-%m - Everyday') END AS folder,
 src NOT IN ('exif', 'takeout', 'inferred_local', 'none', 'rejected_sentinel', 'rejected_future', 'rejected_early') AS needs_review FROM c JOIN w USING (id)""")(
    lambda t: pipelines.plan(t.media, _now(), taken="taken_at").select("id", "label", "captured_at", "source", "folder", "needs_review"))
query("k4_organize_preview", f"""WITH {RULES}, {DATED}, {EMBED}, {RESOLVED}, {SHOTS}, w AS (SELECT z.id, src, CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'takeout' THEN z.taken_at WHEN 'filename' THEN fd END cap FROM z),
p AS (SELECT ks.*, c.label, c.name, c.rule, src, cap, CASE WHEN regexp_matches(lower(c.name), '[.](jpg|png|heic|webp)$') THEN 'photo' WHEN regexp_matches(lower(c.name), '[.](mp4|mov)$') THEN 'video' END kind, bucket IN ('unique', 'near') goes FROM ks JOIN c USING (id) JOIN w USING (id)),
lb AS (SELECT label, count(*) n FROM p WHERE goes GROUP BY 1), dy AS (SELECT CAST(cap AS DATE) d FROM p WHERE rule IN ('device', 'camera_filename') UNION ALL SELECT CAST(captured_at AS DATE) FROM files WHERE category = 'Camera' AND event_id IS NULL AND CAST(captured_at AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE user_id % 5 = 0)),
hv AS (SELECT d FROM dy WHERE d IS NOT NULL GROUP BY d HAVING count(*) > {HEAVY})
SELECT count(*) AS files, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos, 0::BIGINT AS audio, count(*) FILTER (bucket = 'unique') AS new_unique, count(*) FILTER (bucket = 'near') AS near_dup, count(*) FILTER (bucket = 'exact') AS exact_dup, count(*) FILTER (bucket = 'unreadable') AS unreadable,
 count(*) FILTER (goes AND cap IS NULL) AS undated, count(*) FILTER (goes AND cap IS NOT NULL) AS will_organize, coalesce(sum(size) FILTER (bucket = 'exact'), 0)::BIGINT AS reclaimable_bytes, coalesce(sum(size) FILTER (bucket = 'near'), 0)::BIGINT AS near_bytes, coalesce(sum(size) FILTER (goes), 0)::BIGINT AS need_bytes,
 count(*) FILTER (goes AND src = 'rejected_sentinel') AS sentinel_rejected, count(*) FILTER (goes AND src = 'rejected_future') AS future_rejected,
 count(*) FILTER (goes AND src IN ('exif', 'takeout', 'inferred_local') AND cap IN (TIMESTAMP '2000-01-01', TIMESTAMP '1999-12-31', TIMESTAMP '1980-01-01')) AS suspect_default, count(*) FILTER (goes AND src = 'inferred_local') AS shifted, count(*) FILTER (goes AND src = 'filename') AS needs_review, count(*) FILTER (goes AND rule IN ('device', 'camera_filename') AND CAST(cap AS DATE) IN (SELECT d FROM hv)) AS on_heavy_days,
 min(cap) FILTER (goes) AS earliest, max(cap) FILTER (goes) AS latest, (SELECT string_agg(label || ':' || CAST(n AS STRING), ';' ORDER BY n DESC, label) FROM lb) AS folders FROM p""")(lambda t: _preview(t))
query("a14_inferred_shifts", f"WITH {DATED}, {EMBED}, {RESOLVED} SELECT id, evid AS evidence, CAST(mins AS INT) AS minutes FROM z WHERE src = 'inferred_local'")(
    lambda t: pipelines.inferred_local_shifts(dates.with_capture_datetime(t.media, _now(), taken="taken_at", out="r").select("id", "r.source", "r.tag")))
query("a23_uncompared_photos", "WITH u AS (SELECT source_path AS path FROM files WHERE lower(split_part(original_name, '.', -1)) IN ('jpg', 'heic', 'png') AND size % 3 > 0 AND perceptual IS NULL) SELECT path, (SELECT count(*) FROM u) AS total FROM u ORDER BY path LIMIT 20")(
    lambda t: duplicates.uncompared_photos(t.files.withColumns({"path": F.col("source_path"), "perceptual_computed": F.col("size") % 3 > 0}), origin.media_kind(F.col("original_name"))))
query("a30_write_candidates", f"WITH {KIND} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (size > 3000) AS oversized FROM k WHERE kind <> 'exact' AND size % 4 <> 0")(
    lambda t: duplicates.write_candidates(_resolved(t), 3000, skip_undated=True))
query("t5_folder_groups", "WITH g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) folder, count(*) files FROM docs GROUP BY 1) SELECT folder, files, (SELECT count(*) FROM g) AS folders FROM g ORDER BY files DESC, folder LIMIT 20")(
    lambda t: duplicates.folder_groups(t.docs, paths.parent(F.col("path"))))
query("j23_apply_events", "SELECT sha256, CASE WHEN event_id IS NOT NULL AND captured_at IS NOT NULL THEN strftime(captured_at, '%Y/%Y-%m-%d') || ' - Event ' || CAST(event_id AS STRING) ELSE 'old' END AS folder FROM files")(
    lambda t: timeline.apply_events(t.files.select("sha256", F.lit("old").alias("folder")), t.files.where("event_id IS NOT NULL AND captured_at IS NOT NULL").select("sha256", F.col("captured_at").alias("start"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("name")), composed=True))
TRIP_DAYS = "old AS (SELECT DISTINCT user_id % 5 AS trip_id, CAST(ts AS DATE) + CAST(user_id % 5 * 400 AS INT) AS day FROM events WHERE event_id % 3 = 0 AND day(ts) < 20), new AS (SELECT DISTINCT user_id % 5 AS trip_id, CAST(ts AS DATE) + CAST(user_id % 5 * 400 AS INT) AS day FROM events)"


def _trip_days(t, where):
    return t.raw("events").where(where).selectExpr("user_id % 5 AS trip_id", "date_add(CAST(ts AS DATE), CAST(user_id % 5 * 400 AS INT)) AS day").distinct()


query("s15_record_trips", f"WITH {TRIP_DAYS}, a AS (SELECT * FROM old UNION ALL SELECT min(trip_id), day FROM new WHERE day NOT IN (SELECT day FROM old) GROUP BY day) SELECT trip_id, min(day) AS start_date, max(day) AS end_date, count(*) AS days FROM a GROUP BY 1".replace("SELECT min(trip_id), day FROM new", "SELECT min(trip_id) AS trip_id, day FROM new"))(
    lambda t: timeline.record_trips(_trip_days(t, "event_id % 3 = 0 AND day(ts) < 20"), _trip_days(t, "true"))[1])
query("s15_record_events", "SELECT event_id AS signature, CASE WHEN event_id % 4 = 0 THEN 'new' ELSE event_type END AS name FROM events WHERE event_id % 2 = 0 OR event_id % 4 = 0")(
    lambda t: timeline.record_events(t.raw("events").where("event_id % 2 = 0").selectExpr("event_id AS signature", "event_type AS name"), t.raw("events").where("event_id % 4 = 0").selectExpr("event_id AS signature", "'new' AS name")))
INGEST = """m AS (SELECT shots.*, media.name, CAST(id % 40 AS STRING) folder, taken_at FROM media JOIN shots USING (id)), j AS (SELECT DISTINCT folder, name, max(taken_at) taken FROM m WHERE part > 0 AND length(name) % 5 > 0 GROUP BY 1, 2)"""
query("k5_ingest_preview", f"""WITH {DATED}, {EMBED}, {INGEST}, y3 AS (SELECT x.* REPLACE (j.taken AS taken_at), m.folder, m.size, m.path, m.part, m.sha256, j.name AS sidecar FROM x JOIN m USING (id) LEFT JOIN j ON j.folder = m.folder AND j.name = m.name WHERE m.part > 0), {RESOLVED.replace('FROM x', 'FROM y3')},
n AS (SELECT path, CASE WHEN sha256 IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY sha256 ORDER BY part > 0, path) END n FROM shots)
SELECT src AS date_source, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS collapsed, coalesce(sum(size) FILTER (n > 1), 0)::BIGINT AS freed, count(*) FILTER (sidecar IS NULL) AS missing_sidecars FROM z JOIN n USING (path) GROUP BY 1""")(lambda t: _ingest(t))


def _ingest(t):
    batch = t.media.select("id", "name", "tags", "taken_at").join(t.shots.where("part > 0"), "id").withColumn("folder", (F.col("id") % 40).cast("string"))
    jsons = batch.where("char_length(name) % 5 > 0").groupBy("folder", "name").agg(F.max("taken_at").alias("taken_at")).withColumn("name", F.concat("name", F.lit(".json")))
    return pipelines.ingest_preview(t.shots.where("part = 0"), batch.drop("taken_at"), jsons, _now())


query("k9_reconcile_decisions", f"""WITH {SECTION}, r AS ({LATEST}), m AS (SELECT * FROM r WHERE n = 1), cf AS (SELECT key AS sha256, (list(written ORDER BY event_id DESC))[1] cap, max(event_id) tm FROM sec GROUP BY key),
a AS (SELECT 'events' AS section, CASE WHEN key LIKE '1%' THEN 'unmatched' WHEN len(key) % 2 = 0 THEN 'unchanged' ELSE 'applied' END AS action FROM m
 UNION ALL SELECT 'date_confirmations', CASE WHEN len(sha256) % 2 = 0 THEN CASE WHEN tm % 3 = 0 AND cap IS NOT NULL THEN 'newer_locally' ELSE 'unchanged' END WHEN sha256 LIKE '1%' THEN 'awaiting_content' ELSE 'applied' END FROM cf
 UNION ALL SELECT 'settings', CASE WHEN len(key) % 3 = 0 THEN 'unchanged' ELSE 'applied' END FROM m)
SELECT section, action, count(*) AS decisions FROM a GROUP BY 1, 2""")(lambda t: _reconcile(t))


def _reconcile(t):
    section = _section(t)
    merged = decisions.merge_section(section)
    names = merged.where("key NOT LIKE '1%'").select(F.col("key").alias("signature"), F.when(F.char_length("key") % 2 == 0, F.col("value")).otherwise("old").alias("name"))
    confirmations = section.selectExpr("drive_uuid", "written", "key AS sha256", "written AS captured_at", "event_id AS confirmed_at")
    newest = decisions.merge_confirmations(confirmations)
    held = newest.where("char_length(sha256) % 2 = 0").selectExpr("sha256", "CASE WHEN confirmed_at % 3 = 0 THEN captured_at + INTERVAL '1' DAY ELSE captured_at END AS captured_at", "confirmed_at + 1 AS confirmed_at")
    settings = merged.where("char_length(key) % 3 = 0").select("key", "value")
    return pipelines.reconcile_decisions(section, section, confirmations, names, settings, held, newest.where("sha256 NOT LIKE '1%'"))


query("j28_restore_trips", """WITH d AS (SELECT o_custkey AS trip, 'T' || CAST(o_custkey AS STRING) AS name, CASE WHEN o_custkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders GROUP BY ALL), k AS (SELECT CAST(o_orderdate AS DATE) AS day, 'T' || CAST(min(o_custkey) AS STRING) AS name FROM orders WHERE o_orderkey % 6 = 0 GROUP BY 1),
g AS (SELECT trip, d.name, count(d.day) n, count(k.name) h, count(*) FILTER (k.name = d.name) o FROM d LEFT JOIN k ON k.day = d.day GROUP BY 1, 2) SELECT trip, name, CASE WHEN n = 0 THEN 'dayless' WHEN o = n THEN 'unchanged' WHEN h > 0 THEN 'conflicting' ELSE 'applied' END AS action FROM g""")(lambda t: decisions.restore_trips(
    t.raw("orders").selectExpr("o_custkey AS trip", "'T' || CAST(o_custkey AS STRING) AS name", "CASE WHEN o_custkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day").distinct(),
    t.raw("orders").where("o_orderkey % 6 = 0").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.concat(F.lit("T"), F.min("o_custkey").cast("string")).alias("name"))))
query("c19_preflight", f"WITH {KIND} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (size > 30000) AS oversized, sum(size) <= 2000000 AND count(*) FILTER (size > 30000) = 0 AS fits FROM k WHERE kind <> 'exact'")(
    lambda t: duplicates.preflight(duplicates.write_candidates(_resolved(t), 30000), 2_000_000))
# documents of the four drives are written and read again; a fifth of the settings is of one machine, and some sections are unknown
DOCUMENTS = """SELECT drive_uuid, CASE WHEN event_id % 7 = 0 THEN 'settings' WHEN event_id % 7 = 1 THEN 'unknown' WHEN event_id % 7 < 5 THEN 'events' ELSE 'albums' END AS section,
 CASE WHEN event_id % 5 = 0 THEN 'path_hint.' ELSE 'k' END || CAST(event_id AS STRING) AS key, CAST(event_id AS STRING) AS value FROM sec"""
query("s7_decision_documents", f"WITH {SECTION}, r AS ({DOCUMENTS}) SELECT drive_uuid, section, key, value FROM r WHERE NOT (section = 'settings' AND key LIKE 'path_hint%')")(lambda t: _documents(t))


def _documents(t):
    rows = t.spark.sql(DOCUMENTS.replace("FROM sec", "FROM {sec}"), sec=_section(t))
    name = F.when(F.col("section") == "events", "signature").otherwise("name")
    item = F.when(F.col("section").isin("events", "albums"), F.to_json(F.map_from_arrays(F.array(name, F.lit("value")), F.array("key", "value")))).otherwise(F.concat(F.lit('"'), "value", F.lit('"')))
    none = F.lit(None).cast("string")
    path = fresh_path(t.spark, "documents")
    documents.write_documents(rows.select("drive_uuid", none.alias("label"), none.alias("notes"), none.alias("written"), "section", F.lit(0).alias("place"), "key", F.parse_json(item).alias("item")), path)
    read = documents.read_documents(t.spark, f"{path}/drive=*")
    return read.select("drive_uuid", "section", "key", F.coalesce(F.try_variant_get("item", "$.value", "string"), F.try_variant_get("item", "$", "string")).alias("value"))


# the incremental operators on the given tables as one batch

query("r1_ingest_rows", f"""WITH {RULES}, {DATED}, {EMBED}, y4 AS (SELECT * REPLACE (NULL::TIMESTAMP AS taken_at) FROM x), {RESOLVED.replace('FROM x', 'FROM y4')}
SELECT md5(CAST(c.id AS STRING)) AS sha256, label, rule, src AS date_source, CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'filename' THEN fd END AS captured_at FROM c JOIN z USING (id) WHERE c.id % 3 > 0""")(
    lambda t: streaming.ingest_rows(t.media.select(F.md5(F.col("id").cast("string")).alias("sha256"), "name", "tags"), t.media.where("id % 3 = 0").select(F.md5(F.col("id").cast("string")).alias("sha256")), _now()).select("sha256", "label", "rule", "date_source", "captured_at"))
query("r3_session_events", """WITH g AS (SELECT library, captured_at, CASE WHEN captured_at - lag(captured_at) OVER w < INTERVAL 48 HOUR THEN 0 ELSE 1 END nw FROM items WINDOW w AS (PARTITION BY library ORDER BY captured_at)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY library ORDER BY captured_at) k FROM g) SELECT library, count(*) AS files, min(captured_at) AS "start", max(captured_at) AS "end" FROM s GROUP BY library, k HAVING count(*) >= 8""")(lambda t: streaming.session_events(t.items))
LATE = "key % 41 = 3"
BEFORE = ", ".join(x.strip() for x in [re.sub(r"\b(g|l|md|e|s|ev)\b(?= AS \(|$)", r"\1_b", SEGMENTS)])
BEFORE = re.sub(r"FROM (items|g|l|md|e|s)\b", lambda m: f"FROM {m.group(1)}_b", BEFORE)
BEFORE = f"items_b AS (SELECT * FROM items WHERE NOT ({LATE})), {BEFORE}"


def _corrected(t):
    """A timeline without some rows of all libraries and days, to which these then come late, in two batches of which the
    first comes twice."""
    state = corrections.cluster(t.items.where(f"NOT ({LATE})"))
    early = t.items.where(f"{LATE} AND library % 2 = 0")
    once = corrections.correct(state, early)
    again = corrections.correct(once.timeline, early.unionByName(t.items.where(f"{LATE} AND library % 2 = 1")))
    return once, again


query("r4_corrected_events", f'WITH {SEGMENTS} SELECT library, files, "start", "end", lat, lon, signature FROM ev')(
    lambda t: _corrected(t)[1].timeline.events().withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)}))
query("r4_changed_events", f"""WITH {SEGMENTS}, {BEFORE} SELECT library, signature, 'gone' AS change FROM ev_b WHERE signature NOT IN (SELECT signature FROM ev)
 UNION ALL SELECT library, signature, 'new' FROM ev WHERE signature NOT IN (SELECT signature FROM ev_b)""")(lambda t: reduce(DataFrame.unionByName, (c.changes for c in _corrected(t))))
query("r4_named_trips", f"""WITH {SEGMENTS}, {TRIPS}, {NAMED} SELECT tr.library, start_date, end_date, tr.files, arg_min(cd.name, cd.day) AS name FROM tr LEFT JOIN rr ON rr.library = tr.library AND rr.day BETWEEN start_date AND end_date
 LEFT JOIN cd ON cd.library = tr.library AND cd.day = rr.day GROUP BY ALL""")(lambda t: _corrected(t)[1].timeline.trips(_claimed(t)).select("library", "start_date", "end_date", "files", "name"))
query("r4_late_rows", "SELECT key, library FROM items JOIN (SELECT library, max(captured_at) - INTERVAL 10 DAY AS until FROM items GROUP BY 1) USING (library) WHERE captured_at <= until")(
    lambda t: streaming.late_rows(t.items, t.items.groupBy("library").agg((F.max("captured_at") - F.expr("INTERVAL '10' DAY")).alias("until")))[1].select("key", "library"))


# the incremental operators as streams over files that come one after the other, stopped halfway and started again


def _streamed(t, rows, parts, build, name):
    """What a stream gives of a table's parts, each of which is written by as many tasks as the table has and is one
    batch: it is stopped after the first one, and goes on from its checkpoint whenever another has come."""
    path = fresh_path(t.spark, name)
    writer = build(files(t.spark, rows.schema, f"{path}/in", None), f"{path}/out", f"{path}/checkpoint")
    with rocks_store(t.spark):
        for n, part in enumerate(parts):
            part.write.parquet(f"{path}/in/{n}")
            run(writer, batches=None if n else 1)
    return f"{path}/out"


def _by_time(rows, at, edges):
    """A table in parts by time."""
    edges = [None, *(F.lit(e).cast("timestamp") for e in edges), None]
    within = lambda a, b: (F.lit(True) if a is None else F.col(at) >= a) & (F.lit(True) if b is None else F.col(at) < b)
    return [rows.where(within(a, b)) for a, b in zip(edges, edges[1:])]


EDGES = ("2024-01-08", "2024-01-15", "2024-01-20")
ISLANDS = re.sub(r"PARTITION BY library\b", "PARTITION BY library, island", SEGMENTS).replace("FROM items", "FROM items_i").replace("SELECT library, segment, count", "SELECT library, island, segment, count").replace("GROUP BY 1, 2 HAVING", "GROUP BY 1, 2, 3 HAVING")


@query("r3_event_stream", f"""WITH k AS (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER w <= INTERVAL 48 HOUR THEN 0 ELSE 1 END nw FROM items WINDOW w AS (PARTITION BY library ORDER BY captured_at, sha256)),
ki AS (SELECT *, sum(nw) OVER (PARTITION BY library ORDER BY captured_at, sha256) island FROM k), kc AS (SELECT library, island FROM ki GROUP BY 1, 2 HAVING max(captured_at) + INTERVAL 49 HOUR < (SELECT max(captured_at) FROM items)),
items_i AS (SELECT ki.* FROM ki SEMI JOIN kc USING (library, island)), {ISLANDS}
SELECT library, files, "start", "end", lat, lon, signature FROM ev""")
def _event_stream(t):
    rows = t.items.select("library", "sha256", F.col("captured_at").cast("timestamp").alias("captured_at"), "lat", "lon")
    out = _streamed(t, rows, _by_time(rows, "captured_at", EDGES), lambda s, path, cp: to_files(streaming.event_stream(s), path, cp), "events")
    made = t.spark.read.schema("library bigint, files bigint, start timestamp, end timestamp, lat double, lon double, signature string").parquet(out)
    return made.select("library", "files", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), *(F.round(c, 6).alias(c) for c in ("lat", "lon")), "signature")


@query("r2_dedup_stream", "SELECT DISTINCT md5(CAST(library AS STRING) || '/' || strftime(captured_at, '%Y-%m-%d')) AS sha256 FROM items")
def _dedup_stream(t):
    content = F.md5(F.concat_ws("/", F.col("library").cast("string"), F.date_format("captured_at", "yyyy-MM-dd")))
    rows = t.items.select(content.alias("sha256"), F.col("captured_at").cast("timestamp").alias("captured_at"))
    out = _streamed(t, rows, _by_time(rows, "captured_at", EDGES), lambda s, path, cp: to_files(streaming.dedup_stream(s), path, cp), "firsts")
    return t.spark.read.schema(rows.schema).parquet(out).select("sha256")


@query("r1_ingest_stream", f"""WITH {RULES}, {DATED}, {EMBED}, y4 AS (SELECT * REPLACE (NULL::TIMESTAMP AS taken_at) FROM x), {RESOLVED.replace('FROM x', 'FROM y4')}
SELECT md5(CAST(c.id AS STRING)) AS sha256, label, rule, src AS date_source, CASE src WHEN 'inferred_local' THEN loc WHEN 'exif' THEN val WHEN 'filename' THEN fd END AS captured_at FROM c JOIN z USING (id)""")
def _ingest_stream(t):
    rows = t.media.select(F.md5(F.col("id").cast("string")).alias("sha256"), "name", "tags", "id")
    # the last part brings all of the first one again
    parts = [rows.where("id % 3 = 0"), rows.where("id % 3 = 1"), rows.where("id % 3 <> 1")]
    each = lambda s, path, cp: lambda: s.writeStream.foreachBatch(streaming.ingest_batch(path)).option("checkpointLocation", cp)
    out = _streamed(t, rows, parts, each, "ingested")
    return t.spark.read.parquet(out).select("sha256", "label", "rule", "date_source", "captured_at")
