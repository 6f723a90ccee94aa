"""Queries over files, copies and drives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumibase.functions import dates, measures
from lumibase.operators import catalog, copies as on_drives
from lumibase.operators.recorded import Catalog
from lumibase.operators.stages import fresh_path
from lumibase.plans.registry import query

NOW = "2005-01-01 00:00:00"
SIDE = "category IN ('Screenshots', 'Saved')"

query("a1_stats_summary", """WITH c AS (SELECT sha256, count(*) n, count(last_verified) v FROM copies GROUP BY 1), h AS (SELECT f.*, coalesce(n, 0) n, v FROM files f LEFT JOIN c USING (sha256))
SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, count(*) FILTER (n >= 2) AS on_two_drives, count(*) FILTER (n = 1) AS on_one_drive, count(*) FILTER (n = 0) AS on_no_drive,
 count(*) FILTER (coalesce(v, 0) = 0) AS never_verified, count(*) FILTER (captured_at IS NULL) AS undated, count(*) FILTER (captured_at IS NOT NULL AND category = 'Camera') AS timeline, count(*) FILTER (captured_at IS NULL OR category <> 'Camera') AS side_bin,
 min(captured_at) AS earliest, max(captured_at) AS latest FROM h""")(lambda t: catalog.stats_summary(t.files, t.copies))

query("a2_custody_floor", """WITH c AS (SELECT sha256, count(*) FILTER (missing_at IS NULL) n FROM copies GROUP BY 1), h AS (SELECT coalesce(n, 0) n FROM files LEFT JOIN c USING (sha256))
SELECT count(*) FILTER (n = 0) AS no_copy, count(*) FILTER (n = 1) AS one_copy, min(n)::BIGINT AS floor, count(*) FILTER (n > 0) AS held, (min(n) FILTER (n > 0))::BIGINT AS held_floor,
 count(*) FILTER (n = (SELECT min(n) FROM h WHERE n > 0)) AS at_held_floor FROM h""")(lambda t: catalog.custody_floor(t.files, t.copies))

query("a3_list_drives", """WITH c AS (SELECT drive_uuid uuid, count(*) files, count(missing_at) missing, count(last_verified) confirmed, sum(size)::BIGINT bytes, max(missing_at) last_missing,
 CASE WHEN count(*) = count(last_verified) THEN min(last_verified) END verified FROM copies GROUP BY 1)
SELECT uuid, label, coalesce(files, 0) AS files, coalesce(missing, 0) AS missing, coalesce(confirmed, 0) AS confirmed, coalesce(bytes, 0) AS bytes, last_missing, verified FROM drives LEFT JOIN c USING (uuid)""")(
    lambda t: catalog.list_drives(t.drives, t.copies))

query("a4_drive_verified", """SELECT drive_uuid AS uuid, CASE WHEN count(*) = count(last_verified) THEN min(last_verified) END AS verified FROM copies GROUP BY 1""")(
    lambda t: catalog.list_drives(t.drives, t.copies).where("files > 0").select("uuid", "verified"))

query("a5_content_totals", """WITH s AS (SELECT sha256 FROM copies WHERE missing_at IS NULL GROUP BY 1 HAVING count(*) = 1)
SELECT count(*) AS files, sum(size)::BIGINT AS bytes, (SELECT count(*) FROM s) AS single_copies FROM files""")(lambda t: catalog.content_totals(t.files, t.copies))

#: F28 by its stated meanings: source, label, detail, review.
MEANINGS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in s[:3]) + f"', {s[3]})" for s in dates.SOURCES)
SENTENCE = """CASE WHEN coalesce(date_tag, '') = '' THEN NULL WHEN date_source IS DISTINCT FROM 'inferred_local' THEN 'from ' || date_tag WHEN date_tag LIKE '%|not_proven_utc' THEN split_part(date_tag, '|', 1) || ', taken as local'
 WHEN regexp_matches(date_tag, '^[^|]+[|][^|]+[|][+-][0-9]{2}:[0-5][0-9]$') THEN split_part(date_tag, '|', 1) || ', moved ' || split_part(date_tag, '|', 3) || ' by ' || split_part(date_tag, '|', 2) ELSE date_tag END"""
query("a6_date_provenance", f"""WITH m(source, label, detail, review) AS (VALUES {MEANINGS}), e AS (SELECT date_source, {SENTENCE} AS said FROM files),
g AS (SELECT date_source, count(*) AS files, list_sort(list_distinct(list(said) FILTER (said IS NOT NULL)))[1:4] AS says FROM e GROUP BY 1)
SELECT date_source, coalesce(label, '{dates.UNRECORDED[0]}') AS label, coalesce(detail, '{dates.UNRECORDED[1]}') AS detail, files, coalesce(review, false) AS review, nullif(array_to_string(says, ', '), '') AS evidence, date_source IS NULL AS not_recorded,
 CASE WHEN date_source IS NOT NULL THEN round(files / sum(files) FILTER (date_source IS NOT NULL) OVER (), 6) END AS share, (sum(files) OVER ())::BIGINT AS total, coalesce(sum(files) FILTER (date_source IS NOT NULL) OVER (), 0)::BIGINT AS recorded
 FROM g LEFT JOIN m ON source = date_source""")(lambda t: catalog.date_provenance(t.files))

query("a7_by_year", "SELECT year(captured_at) AS year, count(*) AS files, min(captured_at) AS first, max(captured_at) AS last FROM files GROUP BY 1")(lambda t: catalog.by_year(t.files))

query("a8_counts_by_format", """SELECT CASE ext WHEN 'jpg' THEN 'image' WHEN 'heic' THEN 'image' WHEN 'png' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'opus' THEN 'audio' ELSE 'other' END AS kind, ext AS extension,
 count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT *, lower(split_part(original_name, '.', -1)) ext FROM files) GROUP BY 1, 2""")(lambda t: catalog.counts_by_format(t.files))

query("a9_near_dup_flagged", "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files FROM (SELECT count(*) n FROM files WHERE perceptual IS NOT NULL GROUP BY perceptual HAVING count(*) > 1)")(
    lambda t: catalog.near_dup_flagged(t.files))

query("a18_custody_freshness", f"""WITH d AS (SELECT drive_uuid, CASE WHEN count(*) = count(last_verified) THEN min(last_verified) END v FROM copies GROUP BY 1), j AS (SELECT label, v FROM d JOIN drives ON uuid = drive_uuid),
a AS (SELECT count(*) FILTER (v IS NULL) AS never_checked, coalesce(string_agg(label, ';' ORDER BY label) FILTER (v IS NULL), '') AS never_checked_names, min(v) AS oldest_check, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(min(v))) / 86400))::BIGINT AS days FROM j)
SELECT never_checked, never_checked_names, oldest_check, days AS age_days, CASE WHEN days >= 90 THEN 'stale' WHEN days >= 30 THEN 'softening' ELSE 'fresh' END AS tier FROM a""")(
    lambda t: catalog.custody_freshness(t.drives, t.copies, NOW))

query("a19_label_routes", f"SELECT category, count(*) AS files, CASE WHEN {SIDE} THEN 'side_bin' ELSE 'ambiguous' END AS route FROM files GROUP BY category")(lambda t: catalog.label_routes(t.files))

RUNS = "SELECT o_orderkey AS run_id, CAST(o_custkey % 100 AS STRING) AS drive_uuid, o_orderkey % 900 AS intended, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at FROM {orders}"
MOVES = "SELECT l_orderkey AS run_id, CAST(l_partkey % 40 AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '.jpg' AS old_relative, 'new/' || CAST(l_linenumber AS STRING) || '.jpg' AS new_relative, l_shipdate AS moved_at FROM {lineitem}"
runs = lambda t: t.spark.sql(RUNS, orders=t.raw("orders"))
moves = lambda t: t.spark.sql(MOVES, lineitem=t.raw("lineitem"))
SQL_RUNS, SQL_MOVES = f"runs AS ({RUNS.format(orders='orders')})", f"moves AS ({MOVES.format(lineitem='lineitem')})"

query("a20_unfinished_runs", f"""WITH {SQL_RUNS}, h AS (SELECT drive_uuid, count(*) held FROM copies GROUP BY 1)
SELECT run_id, drive_uuid, intended, coalesce(held, 0) AS held FROM runs LEFT JOIN h USING (drive_uuid) WHERE finished_at IS NULL AND coalesce(held, 0) < intended""")(lambda t: catalog.unfinished_runs(runs(t), t.copies))

query("a21_runs_with_counts", f"""WITH {SQL_RUNS}, {SQL_MOVES}, m AS (SELECT run_id, count(*) moves, max(moved_at) last_move FROM moves GROUP BY 1)
SELECT run_id, drive_uuid, intended, finished_at, coalesce(moves, 0) AS moves, last_move FROM runs LEFT JOIN m USING (run_id)""")(lambda t: catalog.runs_with_counts(runs(t), moves(t)))

query("j6_copies_on_drive", "SELECT sha256, relative, captured_at, source_path FROM copies JOIN files USING (sha256) WHERE drive_uuid = '7' AND category = 'Camera' AND captured_at IS NOT NULL")(
    lambda t: catalog.copies_on_drive(t.files, t.copies, "7", "Camera"))

CANDIDATES = "cand AS (SELECT c.sha256, relative, copy_sha256, last_verified, source_path, f.size, n AS copies FROM copies c JOIN files f USING (sha256) JOIN (SELECT sha256, count(*) n FROM copies GROUP BY 1) USING (sha256) WHERE drive_uuid = '9')"
query("j7_reclaim_candidates", f"WITH {CANDIDATES} SELECT * FROM cand")(lambda t: catalog.reclaim_candidates(t.files, t.copies, "9"))

query("j8_reclaim_plan", f"""WITH {CANDIDATES}, l AS (SELECT DISTINCT source_path FROM files WHERE size % 3 <> 0),
o AS (SELECT relative, CASE WHEN size % 5 = 0 THEN 'other' ELSE sha256 END digest FROM copies WHERE drive_uuid = '9' AND size % 11 <> 0)
SELECT CASE WHEN l.source_path IS NULL THEN 'missing_source' WHEN cand.source_path = '/src/' || relative THEN 'source_is_copy' WHEN copy_sha256 IS NULL OR digest IS NULL OR digest <> copy_sha256 THEN 'unverified' WHEN copies < 3 THEN 'below_min_copies' ELSE 'candidate' END AS bucket,
 count(*) AS files, sum(size)::BIGINT AS bytes FROM cand LEFT JOIN l ON l.source_path = cand.source_path LEFT JOIN o USING (relative) GROUP BY 1""")(
    lambda t: catalog.reclaim_plan(catalog.reclaim_candidates(t.files, t.copies, "9"), t.files.where("size % 3 <> 0").select(F.col("source_path").alias("path")),
        t.copies.where("drive_uuid = '9' AND size % 11 <> 0").selectExpr("relative", "CASE WHEN size % 5 = 0 THEN 'other' ELSE sha256 END AS digest"), "/src/", 3))

FOUND = "SELECT sha256, original_name, relative, label FROM copies JOIN files USING (sha256) JOIN drives ON uuid = drive_uuid WHERE original_name ILIKE '%_12%' OR relative ILIKE '%_12%' OR source_path ILIKE '%_12%'"
query("j9_find_copies", FOUND)(lambda t: catalog.find_copies(t.files, t.copies, t.drives, "_12"))
query("t3_find_copies_page", f"WITH r AS ({FOUND}) SELECT *, (SELECT count(*) FROM r) AS total, CAST(ceil((SELECT count(*) FROM r) / 50) AS BIGINT) AS pages FROM r ORDER BY sha256, label, relative LIMIT 50 OFFSET 100")(lambda t: catalog.page(catalog.find_copies(t.files, t.copies, t.drives, "_12"), ["sha256", "label", "relative"], 2))

query("j10_single_copy", """WITH o AS (SELECT sha256 FROM copies WHERE missing_at IS NULL GROUP BY 1 HAVING count(*) = 1)
SELECT sha256, original_name, label, relative FROM copies SEMI JOIN o USING (sha256) JOIN files USING (sha256) JOIN drives ON uuid = drive_uuid WHERE missing_at IS NULL""")(lambda t: catalog.single_copy(t.files, t.copies, t.drives))

query("j11_zero_drive", "SELECT sha256, size, category FROM files ANTI JOIN copies USING (sha256)")(lambda t: catalog.zero_drive(t.files, t.copies).select("sha256", "size", "category"))

CONFIRMED = "conf AS (SELECT sha256, captured_at + INTERVAL 1 DAY AS captured_at FROM files WHERE size % 13 = 0 AND captured_at IS NOT NULL)"
confirmed = lambda t: t.files.where("size % 13 = 0 AND captured_at IS NOT NULL").select("sha256", F.expr("captured_at + INTERVAL 1 DAY").alias("captured_at"))
query("j12_confirmations_to_bake", f"WITH {CONFIRMED} SELECT conf.sha256, conf.captured_at, relative FROM conf JOIN copies USING (sha256) WHERE drive_uuid = '6' AND date_baked_at IS NULL")(lambda t: catalog.confirmations_to_bake(confirmed(t), t.copies, "6"))
query("j12_drives_awaiting_bake", f"WITH {CONFIRMED} SELECT drive_uuid AS uuid, label, count(*) AS files FROM copies SEMI JOIN conf USING (sha256) JOIN drives ON uuid = drive_uuid WHERE date_baked_at IS NULL AND drive_uuid <> '6' GROUP BY 1, 2")(
    lambda t: catalog.drives_awaiting_bake(confirmed(t), t.copies, t.drives, "6"))

query("j13_missing_on_target", "SELECT DISTINCT sha256 FROM copies WHERE drive_uuid = '3' AND missing_at IS NULL AND sha256 NOT IN (SELECT sha256 FROM copies WHERE drive_uuid = '4' AND missing_at IS NULL)")(
    lambda t: catalog.missing_on_target(t.copies, "3", "4"))

query("j25_matched_drives", "SELECT drive_uuid, count(*) AS files FROM (SELECT DISTINCT sha256 FROM files WHERE category = 'Camera') m LEFT JOIN (SELECT DISTINCT sha256, drive_uuid FROM copies) USING (sha256) GROUP BY 1")(
    lambda t: catalog.matched_drives(t.files.where("category = 'Camera'"), t.copies))

query("u1_attachable_hashes", "SELECT sha256, sha256 AS digest FROM files UNION SELECT sha256, copy_sha256 FROM copies WHERE copy_sha256 IS NOT NULL")(lambda t: catalog.attachable_hashes(t.files, t.copies))
query("u2_placed", "SELECT sha256 FROM files INTERSECT SELECT sha256 FROM copies")(lambda t: catalog.placed(t.files, t.copies))
query("u2_unplaced", "SELECT DISTINCT sha256 FROM files ANTI JOIN copies USING (sha256)")(lambda t: catalog.unplaced(t.files, t.copies))

query("t1_largest_files", "SELECT sha256, source_path, size, (SELECT count(*) FROM files WHERE size IS NOT NULL) AS total FROM files WHERE size IS NOT NULL ORDER BY size DESC, source_path, sha256 LIMIT 20")(lambda t: catalog.largest_files(t.files).select("sha256", "source_path", "size", "total"))
query("t2_date_tier", "SELECT sha256, captured_at, (SELECT count(*) FROM files WHERE date_source IS NULL) AS total FROM files WHERE date_source IS NULL ORDER BY captured_at DESC NULLS LAST, sha256 LIMIT 50")(lambda t: catalog.date_tier(t.files, None).select("sha256", "captured_at", "total"))
query("t2_undated_samples", "SELECT sha256, original_name, source_path, (SELECT count(*) FROM files WHERE captured_at IS NULL) AS total FROM files WHERE captured_at IS NULL ORDER BY original_name, sha256 LIMIT 12")(lambda t: catalog.undated_samples(t.files))
query("t2_zero_drive_samples", "WITH z AS (SELECT * FROM files ANTI JOIN copies USING (sha256)) SELECT sha256, original_name, source_path, (SELECT count(*) FROM z) AS total FROM z ORDER BY original_name, sha256 LIMIT 12")(lambda t: catalog.zero_drive_samples(t.files, t.copies))
query("t4_drives_holding", "SELECT label, count(*) AS files FROM copies JOIN drives ON uuid = drive_uuid WHERE missing_at IS NULL GROUP BY label ORDER BY 2 DESC, 1")(
    lambda t: catalog.present(t.copies).join(t.drives, F.col("uuid") == F.col("drive_uuid")).groupBy("label").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "label"))

query("s4_seed_rows", "SELECT source_path, sha256, perceptual FROM files")(lambda t: catalog.seed_rows(t.files))
query("s4_known_sizes", "SELECT DISTINCT size FROM files WHERE size IS NOT NULL")(lambda t: catalog.known_sizes(t.files))
query("s4_organized_files", "SELECT sha256, size FROM files SEMI JOIN copies USING (sha256)")(lambda t: catalog.organized_files(t.files, t.copies))
query("s4_copy_names", "SELECT sha256, split_part(relative, '/', -1) AS name FROM copies WHERE drive_uuid = '6'")(lambda t: catalog.copy_names(t.copies, "6"))
query("s4_media_names", "SELECT DISTINCT original_name, size FROM files WHERE size IS NOT NULL")(lambda t: t.files.where("size IS NOT NULL").select("original_name", "size").distinct())

RERUN = """SELECT CAST(CAST(sha256 AS BIGINT) + 1 AS STRING) AS sha256, size + 1 AS size, CASE WHEN size % 3 > 0 THEN captured_at END AS captured_at, CASE WHEN size % 2 = 0 THEN 'Saved' END AS category,
 CASE WHEN size % 3 > 0 THEN 'exif' ELSE 'none' END AS date_source, CASE WHEN size % 3 > 0 THEN 'DateTimeOriginal' END AS date_tag FROM files WHERE size % 5 = 0"""
INCOMING = f"inc AS ({RERUN})"


def _incoming(t):
    new = t.spark.sql(RERUN.replace("FROM files", "FROM {files}"), files=t.files)
    return new.select("*", *(F.lit(None).cast(t.files.schema[c].dataType).alias(c) for c in t.files.columns if c not in new.columns))


# a third of the new rows have no date any more, and so no source and tag
S5_SQL = f"""WITH {INCOMING}, {CONFIRMED}, m AS (SELECT n.* FROM inc n UNION ALL SELECT sha256, size, captured_at, category, date_source, date_tag FROM files WHERE sha256 NOT IN (SELECT sha256 FROM inc))
SELECT m.sha256, m.size, m.category, CASE WHEN c.sha256 IS NOT NULL THEN c.captured_at ELSE m.captured_at END AS captured_at, CASE WHEN c.sha256 IS NOT NULL THEN 'human_confirmed' ELSE date_source END AS date_source, CASE WHEN c.sha256 IS NULL THEN date_tag END AS date_tag
 FROM m LEFT JOIN conf c ON c.sha256 = m.sha256"""
query("s5_upsert_files", S5_SQL)(lambda t: catalog.upsert_files(t.files, _incoming(t), confirmed(t)).select("sha256", "size", "category", "captured_at", "date_source", "date_tag"))

# re-copies without a digest among them, and copies that are new to the drive
RECOPIED = "SELECT sha256, CASE WHEN size % 5 = 0 THEN 'new' || drive_uuid ELSE drive_uuid END AS drive_uuid, 'again/' || relative AS relative, CASE WHEN size % 2 = 0 THEN 'new-' || sha256 END AS copy_sha256, size + 1 AS size FROM copies WHERE size % 3 = 0"
S6_SQL = f"""WITH n AS ({RECOPIED})
SELECT c.sha256, c.drive_uuid, relative, copy_sha256, size, missing_at, last_verified, date_baked_at FROM copies c ANTI JOIN n USING (sha256, drive_uuid)
UNION ALL SELECT n.sha256, n.drive_uuid, n.relative, n.copy_sha256, n.size, NULL, last_verified, date_baked_at FROM n LEFT JOIN copies c USING (sha256, drive_uuid)"""
query("s6_upsert_copies", S6_SQL)(
    lambda t: catalog.upsert_copies(t.copies, t.spark.sql(RECOPIED.replace("FROM copies", "FROM {copies}"), copies=t.copies)).select("sha256", "drive_uuid", "relative", "copy_sha256", "size", "missing_at", "last_verified", "date_baked_at"))

OUTCOMES = "SELECT sha256, drive_uuid, CASE size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'missing' ELSE 'mismatch' END AS outcome FROM copies WHERE size % 2 = 0"
S10_SQL = f"""WITH x AS ({OUTCOMES}) SELECT c.sha256, c.drive_uuid, CASE outcome WHEN 'verified' THEN TIMESTAMP '{NOW}' WHEN 'missing' THEN NULL ELSE last_verified END AS last_verified,
 CASE outcome WHEN 'verified' THEN NULL WHEN 'missing' THEN TIMESTAMP '{NOW}' ELSE missing_at END AS missing_at FROM copies c LEFT JOIN x ON x.sha256 = c.sha256 AND x.drive_uuid = c.drive_uuid"""
query("s10_apply_verification", S10_SQL)(
    lambda t: catalog.apply_verification(t.copies, t.copies.where("size % 2 = 0").selectExpr("sha256", "drive_uuid", "CASE size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'missing' ELSE 'mismatch' END AS outcome"), NOW).select("sha256", "drive_uuid", "last_verified", "missing_at"))

query("s11_confirm_dates", f"WITH {CONFIRMED} SELECT sha256, drive_uuid, CASE WHEN sha256 NOT IN (SELECT sha256 FROM conf) THEN date_baked_at END AS date_baked_at FROM copies")(
    lambda t: catalog.confirm_dates(t.files, t.copies, confirmed(t))[1].select("sha256", "drive_uuid", "date_baked_at"))

query("s12_record_bakes", f"""SELECT sha256, drive_uuid, CASE WHEN size % 4 = 0 THEN 'baked-' || sha256 ELSE copy_sha256 END AS copy_sha256, CASE WHEN size % 4 = 0 THEN TIMESTAMP '{NOW}' ELSE date_baked_at END AS date_baked_at FROM copies""")(
    lambda t: catalog.record_bakes(t.copies, t.copies.where("size % 4 = 0").select("sha256", "drive_uuid", F.concat(F.lit("baked-"), "sha256").alias("copy_sha256"), F.lit(NOW).cast("timestamp_ntz").alias("date_baked_at"))).select("sha256", "drive_uuid", "copy_sha256", "date_baked_at"))

S13_SQL = """WITH g AS (SELECT sha256, drive_uuid FROM copies WHERE size % 2 = 1), l AS (SELECT * FROM copies ANTI JOIN g USING (sha256, drive_uuid))
SELECT sha256, size FROM files WHERE sha256 NOT IN (SELECT sha256 FROM g) OR sha256 IN (SELECT sha256 FROM l)"""
query("s13_forget_content", S13_SQL)(
    lambda t: catalog.forget_content(t.files, t.copies, t.copies.where("size % 2 = 1").select("sha256", "drive_uuid"))[0].select("sha256", "size"))

query("s14_relocate", "SELECT sha256, CASE WHEN size % 9 = 0 THEN '/new/' || sha256 ELSE source_path END AS source_path FROM files")(
    lambda t: catalog.relocate(t.files, t.files.where("size % 9 = 0").select("sha256", F.concat(F.lit("/new/"), "sha256").alias("new")), "source_path").select("sha256", "source_path"))


# the same updates on tables of buckets: what an update leaves of a table that it has not touched is not written again


def _kept(t, **rows):
    own = Catalog(t.spark, fresh_path(t.spark, "catalog"), 16)
    own.create(**rows)
    return own


def _after(own, table, update):
    """The table after an update that is tried twice."""
    if not update() or update():
        raise AssertionError("the first time does all, the second time nothing")
    return own.read(table)


@query("s5_recorded_files", S5_SQL)
def _recorded_files(t):
    own = _kept(t, files=catalog.upsert_files(t.files, t.files.limit(0), confirmed(t)))
    return _after(own, "files", lambda: own.upsert_files(_incoming(t), confirmed(t), "b1")).select("sha256", "size", "category", "captured_at", "date_source", "date_tag")


@query("s6_recorded_copies", S6_SQL)
def _recorded_copies(t):
    own = _kept(t, copies=t.copies)
    new = t.spark.sql(RECOPIED.replace("FROM copies", "FROM {copies}"), copies=t.copies)
    return _after(own, "copies", lambda: own.upsert_copies(new, "b1")).select("sha256", "drive_uuid", "relative", "copy_sha256", "size", "missing_at", "last_verified", "date_baked_at")


@query("s10_recorded_verification", S10_SQL)
def _recorded_verification(t):
    own = _kept(t, copies=t.copies)
    outcomes = t.spark.sql(OUTCOMES.replace("FROM copies", "FROM {copies}"), copies=t.copies)
    return _after(own, "copies", lambda: own.apply_verification(outcomes, NOW, "b1")).select("sha256", "drive_uuid", "last_verified", "missing_at")


@query("s13_recorded_forget", S13_SQL)
def _recorded_forget(t):
    own = _kept(t, files=t.files, copies=t.copies)
    return _after(own, "files", lambda: own.forget_content(t.copies.where("size % 2 = 1").select("sha256", "drive_uuid"), "b1")).select("sha256", "size")


query("f30_custody_age", f"SELECT sha256, drive_uuid, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(last_verified)) / 86400))::BIGINT AS days FROM copies WHERE last_verified IS NOT NULL")(
    lambda t: t.copies.where("last_verified IS NOT NULL").select("sha256", "drive_uuid", measures.age_days(F.col("last_verified"), F.lit(NOW).cast("timestamp_ntz")).cast("long").alias("days")))

# drives against the catalog

query("j17_verify_copies", """WITH o AS (SELECT drive_uuid, relative, CASE WHEN size % 5 = 0 THEN NULL WHEN size % 7 = 0 THEN 'other' ELSE sha256 END AS digest FROM copies WHERE size % 11 <> 0)
SELECT c.sha256, c.drive_uuid, CASE WHEN o.relative IS NULL THEN 'missing' WHEN copy_sha256 IS NULL THEN 'unverifiable' WHEN digest IS NULL THEN 'unreadable' WHEN digest <> copy_sha256 THEN 'mismatch' ELSE 'verified' END AS outcome
 FROM copies c LEFT JOIN o ON o.drive_uuid = c.drive_uuid AND o.relative = c.relative""")(
    lambda t: on_drives.verify_copies(t.copies, t.copies.where("size % 11 <> 0").selectExpr("drive_uuid", "relative", "CASE WHEN size % 5 = 0 THEN NULL WHEN size % 7 = 0 THEN 'other' ELSE sha256 END AS digest")))

RESCAN = """rec AS (SELECT relative AS path, sha256 FROM copies WHERE drive_uuid = '5'), disk AS (SELECT CASE WHEN CAST(sha256 AS BIGINT) % 3 = 0 THEN 'moved/' || sha256 ELSE path END AS path, sha256 FROM rec WHERE CAST(sha256 AS BIGINT) % 7 <> 0
 UNION ALL SELECT 'extra/' || sha256, sha256 FROM rec WHERE CAST(sha256 AS BIGINT) % 13 = 0 UNION ALL SELECT 'x/.tmp' || sha256, NULL FROM rec WHERE CAST(sha256 AS BIGINT) % 10 = 0),
gone AS (SELECT * FROM rec WHERE path NOT IN (SELECT path FROM disk)), fd AS (SELECT DISTINCT sha256, path AS found FROM disk WHERE sha256 IS NOT NULL),
b AS (SELECT path, sha256, 'placed' AS bucket, NULL AS found FROM rec WHERE path IN (SELECT path FROM disk) UNION ALL SELECT gone.path, gone.sha256, CASE WHEN found IS NULL THEN 'unaccounted' ELSE 'moved' END, found FROM gone LEFT JOIN fd USING (sha256)
 UNION ALL SELECT path, sha256, CASE WHEN sha256 IN (SELECT sha256 FROM gone) THEN 'claimed' WHEN sha256 IS NOT NULL THEN 'stray' ELSE 'debris' END, NULL FROM disk WHERE path NOT IN (SELECT path FROM rec))"""
query("j16_rescan_reconcile", f"WITH {RESCAN} SELECT * FROM b")(lambda t: _rescan(t))
query("j16_rescan_report", f"""WITH {RESCAN}, r AS (SELECT count(*) FILTER (bucket = 'placed') AS placed, count(DISTINCT path) FILTER (bucket = 'moved') AS moved, count(*) FILTER (bucket = 'unaccounted') AS unaccounted, count(*) FILTER (bucket = 'claimed') AS claimed,
 count(*) FILTER (bucket = 'stray') AS stray, count(*) FILTER (bucket = 'debris') AS debris, count(*) FILTER (bucket = 'unidentified') AS unidentified, (SELECT count(*) FROM rec WHERE CAST(sha256 AS BIGINT) % 1000 = 1) AS unreadable FROM b)
SELECT *, unreadable = 0 AS complete, unreadable = 0 AND moved + stray + unaccounted = 0 AS reconciled FROM r""")(
    lambda t: on_drives.rescan_report(_rescan(t), t.copies.where("drive_uuid = '5' AND CAST(sha256 AS BIGINT) % 1000 = 1")))


def _rescan(t):
    rec = t.copies.where("drive_uuid = '5'").select(F.col("relative").alias("path"), "sha256")
    n = F.col("sha256").cast("bigint")
    disk = rec.where(n % 7 != 0).select(F.when(n % 3 == 0, F.concat(F.lit("moved/"), "sha256")).otherwise(F.col("path")).alias("path"), "sha256")
    disk = disk.union(rec.where(n % 13 == 0).select(F.concat(F.lit("extra/"), "sha256"), "sha256"))
    junk = rec.where(n % 10 == 0).select(F.concat(F.lit("x/.tmp"), "sha256").alias("path"))
    return on_drives.rescan_reconcile(rec, disk.select("path").union(junk), disk)


query("j20_repoint_plan", "SELECT sha256, source_path, '/mnt/new/1/' || substr(source_path, 8) AS new, size % 2 = 0 AS there FROM files WHERE source_path LIKE '/src/1/%'")(
    lambda t: on_drives.repoint_plan(t.files, t.files.where("size % 2 = 0").select(F.concat(F.lit("/mnt/new/1/"), "sha256", F.lit(".jpg")).alias("path")), "/src/1", "/mnt/new/1").select("sha256", "source_path", "new", "there"))

query("j18_emptied_paths", f"""WITH {SQL_RUNS}, {SQL_MOVES} SELECT DISTINCT old_relative AS path FROM moves JOIN runs USING (run_id) WHERE finished_at IS NOT NULL UNION SELECT old_relative FROM moves WHERE run_id % 50 = 0 AND run_id % 100 = 0""")(
    lambda t: on_drives.emptied_paths(runs(t), moves(t), moves(t).where("run_id % 50 = 0").selectExpr("old_relative", "run_id % 100 AS source_root", "0 AS dest_root")))

query("f36_emptied_ancestors", f"""WITH {SQL_MOVES} SELECT DISTINCT folder, depth FROM (SELECT split_part(old_relative, '/', 1) AS folder, 1 AS depth FROM moves UNION ALL SELECT split_part(old_relative, '/', 1) || '/' || split_part(old_relative, '/', 2), 2 FROM moves)""")(
    lambda t: on_drives.emptied_ancestors(moves(t).select(F.col("old_relative").alias("path"))))

query("k8_cleanup_tiers", f"""WITH {SQL_MOVES}, m AS (SELECT DISTINCT split_part(old_relative, '/', 1) folder FROM moves), l AS (SELECT CAST(CAST(sha256 AS BIGINT) % 60 AS STRING) folder, CAST(sha256 AS BIGINT) % 60 % 3 = 0 junk FROM files WHERE CAST(sha256 AS BIGINT) % 60 % 4 <> 0),
b AS (SELECT folder, bool_or(NOT junk) o FROM l GROUP BY 1) SELECT m.folder, CASE WHEN o IS NULL THEN 'empty' WHEN o THEN 'occupied' ELSE 'junk_only' END AS tier FROM m LEFT JOIN b USING (folder)""")(lambda t: _cleanup(t))


def _cleanup(t):
    n = F.col("sha256").cast("bigint") % 60
    listing = t.files.where(n % 4 != 0).select(F.concat(n.cast("string"), F.when(n % 3 == 0, F.lit("/.")).otherwise(F.lit("/")), "sha256").alias("path"))
    folders = on_drives.emptied_ancestors(moves(t).select(F.col("old_relative").alias("path"))).where("depth = 1").select("folder")
    return on_drives.cleanup_tiers(folders, listing)


query("j19_undo_plan", """WITH m AS (SELECT source_path AS old, 'lib/' || sha256 AS new, captured_at AS moved_at, size FROM files)
SELECT old, new, moved_at, CASE WHEN size % 4 = 0 THEN 'moved_away' WHEN size % 5 = 0 THEN 'origin_occupied' ELSE 'move_back' END AS action FROM m""")(lambda t: _undo(t))


def _undo(t):
    m = t.files.select(F.col("source_path").alias("old"), F.concat(F.lit("lib/"), "sha256").alias("new"), F.col("captured_at").alias("moved_at"), "size")
    listing = m.where("size % 4 <> 0").select(F.col("new").alias("path")).union(m.where("size % 5 = 0").select("old"))
    return on_drives.undo_plan(m.drop("size"), listing)


query("j21_adoption_verdict", """WITH a AS (SELECT drive_uuid, drive_uuid || ':' || relative AS relative, coalesce(copy_sha256, sha256) AS recorded, CAST(sha256 AS BIGINT) AS x, CAST(drive_uuid AS BIGINT) AS d FROM copies),
s AS (SELECT *, row_number() OVER (PARTITION BY drive_uuid ORDER BY relative) - 1 i, count(*) OVER (PARTITION BY drive_uuid) n FROM a),
k AS (SELECT *, (x % 3 > 0 OR d % 4 = 0) AND x % 7 > 0 AS here, x % 7 = 0 AND d % 5 < 3 AS no FROM s WHERE n <= 40 OR (i * 40 + n - 1) // n * n // 40 = i),
r AS (SELECT *, row_number() OVER (PARTITION BY drive_uuid ORDER BY here DESC, relative) - 1 q, count(*) FILTER (here) OVER (PARTITION BY drive_uuid) m FROM k),
j AS (SELECT drive_uuid, count(*) AS sampled, count(*) FILTER (here) AS present, count(*) FILTER (no) AS refused, count(*) FILTER (here AND (m <= 3 OR (q * 3 + m - 1) // m * m // 3 = q)) AS probed, count(*) FILTER (here AND (m <= 3 OR (q * 3 + m - 1) // m * m // 3 = q) AND (d % 8 = 0 OR x % 9 > 0)) AS agreed FROM r GROUP BY 1)
SELECT drive_uuid, sampled, present, refused, CASE WHEN present < 0.5 * sampled THEN 0 ELSE probed END AS probed, CASE WHEN present < 0.5 * sampled THEN 0 ELSE agreed END AS agreed,
 CASE WHEN present < 0.5 * sampled AND present + refused >= 0.5 * sampled THEN 'unreadable' WHEN present < 0.5 * sampled THEN 'no_match' WHEN agreed > 0 AND agreed = probed THEN 'proven' ELSE 'content_differs' END AS verdict, false AS exact FROM j""")(lambda t: _adoption(t))
# the tree of one drive: of all drives it is this one and no other
query("j21_exact_verdict", "SELECT drive_uuid, drive_uuid = '8' AS exact FROM copies GROUP BY 1")(
    lambda t: on_drives.adoption_verdict(t.copies, t.copies.where("drive_uuid = '8'").select(F.col("relative").alias("path")), t.copies.where("drive_uuid = '8'").select(F.col("relative").alias("path"), F.coalesce("copy_sha256", "sha256").alias("digest"))).select("drive_uuid", "exact"))


def _adoption(t):
    # the tree is judged drive by drive; paths carry the drive so that drives don't answer for each other
    own = t.copies.withColumn("relative", F.concat("drive_uuid", F.lit(":"), "relative"))
    n, d = F.col("sha256").cast("bigint"), F.col("drive_uuid").cast("bigint")
    refused = n % 7 == 0
    listing = own.where((refused & (d % 5 < 3)) | (~refused & ((n % 3 > 0) | (d % 4 == 0)))).select(F.col("relative").alias("path"), refused.alias("refused"))
    digests = own.select(F.col("relative").alias("path"), F.when((d % 8 == 0) | (n % 9 > 0), F.coalesce("copy_sha256", "sha256")).otherwise("other").alias("digest"))
    return on_drives.adoption_verdict(own, listing, digests)


query("j30_attach_copies", """WITH r AS (SELECT relative path, sha256 FROM copies WHERE drive_uuid = '8'), d AS (SELECT path, sha256 AS digest FROM r WHERE CAST(sha256 AS BIGINT) % 5 <> 0
 UNION ALL SELECT 'n/' || sha256, CASE WHEN size % 6 = 0 THEN NULL WHEN size % 6 = 1 THEN 'zz' ELSE sha256 END FROM files WHERE CAST(sha256 AS BIGINT) % 4 = 0)
SELECT d.path, CASE WHEN f.sha256 IS NULL THEN NULL ELSE d.digest END AS sha256, CASE WHEN digest IS NULL THEN 'unreadable' WHEN f.sha256 IS NULL THEN 'unmatched' WHEN h.sha256 IS NOT NULL THEN 'already_attached' ELSE 'linked' END AS outcome
 FROM d LEFT JOIN files f ON f.sha256 = digest LEFT JOIN (SELECT DISTINCT sha256 FROM r) h ON h.sha256 = digest WHERE d.path NOT IN (SELECT path FROM r)
UNION ALL SELECT path, sha256, 'absent' FROM r WHERE CAST(sha256 AS BIGINT) % 5 = 0""")(lambda t: _attach(t))


def _attach(t):
    n = F.col("sha256").cast("bigint")
    rec = t.copies.where("drive_uuid = '8'").where(n % 5 != 0).select(F.col("relative").alias("path"), F.col("sha256").alias("digest"))
    new = t.files.where(n % 4 == 0).select(F.concat(F.lit("n/"), "sha256").alias("path"), F.when(F.col("size") % 6 == 0, F.lit(None)).when(F.col("size") % 6 == 1, "zz").otherwise(F.col("sha256")).alias("digest"))
    return on_drives.attach_copies(rec.union(new), t.copies, t.files.select("sha256", F.col("sha256").alias("digest")), "8")


query("j31_original_candidates", """SELECT source_path AS path, CASE WHEN size % 3 = 0 THEN 'unreachable' WHEN size % 3 = 1 AND size % 2 = 0 THEN 'offer' ELSE 'none' END AS outcome,
 CASE WHEN size % 3 = 1 AND size % 2 = 0 THEN TIMESTAMP '1950-09-09 00:00:00' END AS offered FROM (SELECT *, '/u/' || sha256 || '/a.jpg' AS p FROM files)""")(lambda t: _originals(t))


def _originals(t):
    rows = t.files.withColumn("path", F.concat(F.lit("/u/"), "sha256", F.lit("/a.jpg")))
    backup = F.concat("path", F.lit("_original"))
    listing = rows.where("size % 3 <> 0").select("path").union(rows.where("size % 3 = 1").select(backup))
    dates = rows.where("size % 3 = 1 AND size % 2 = 0").select(backup.alias("path"), F.lit("1950-09-09").cast("timestamp_ntz").alias("value"))
    found = on_drives.original_candidates(rows.select("path", "captured_at"), listing, dates)
    return found.join(rows.select("path", "source_path"), "path").select(F.col("source_path").alias("path"), "outcome", "offered")


TAGS = ("Make", "Model", "DateTimeOriginal", "CreateDate")
# files that have changed since, rows without a digest, looks that nobody computed, and tags of a narrower request
KEPT = f"""SELECT path, size, size * 1000 + doc_id % 5 AS mtime, CASE WHEN doc_id % 7 > 0 THEN sha256 END AS sha256, size % 3 > 0 AS perceptual_computed,
 CASE WHEN doc_id % 4 > 0 THEN '{on_drives.tag_fingerprint(TAGS)}' ELSE '{on_drives.tag_fingerprint(TAGS[:2])}' END AS tags_fp, CASE WHEN size % 5 > 0 THEN 'kept' END AS tags FROM docs WHERE doc_id % 3 > 0"""
query("j27_cache_reuse", "SELECT doc_id, x AS reused, CASE WHEN x THEN sha256 END AS sha256 FROM (SELECT doc_id, sha256, doc_id % 3 > 0 AND doc_id % 5 = size % 5 AND doc_id % 7 > 0 AND size % 3 > 0 AND doc_id % 4 > 0 AND size % 5 > 0 AS x FROM docs)")(
    lambda t: on_drives.cache_reuse(t.docs.selectExpr("doc_id", "path", "size", "size * 1000 + size % 5 AS mtime"), t.spark.sql(KEPT.replace("FROM docs", "FROM {docs}"), docs=t.docs), want_perceptual=True, tags=TAGS).select("doc_id", "reused", "sha256"))

query("a15_left_behind", """WITH g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) folder, count(*) files FROM docs WHERE part > 0 GROUP BY 1) SELECT folder, files, (SELECT sum(files) FROM g)::BIGINT AS total, (SELECT count(*) FROM g) AS folders FROM g ORDER BY files DESC, folder LIMIT 5""")(
    lambda t: on_drives.left_behind(t.docs, t.docs.where("part = 0")))

query("s9_archive_set_gaps", """WITH a AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'zip' ELSE 'tar' END format, 'takeout-' || CAST(s_nationkey AS STRING) stem, CAST(s_suppkey % 50 AS INT) n FROM supplier),
g AS (SELECT format, stem, count(*) parts, list(DISTINCT n) ns, min(n) a, max(n) b FROM a GROUP BY 1, 2)
SELECT format, stem, parts, array_to_string(list_filter(range(a, b + 1), lambda x: NOT list_contains(ns, x)), ',') AS missing FROM g""")(
    lambda t: on_drives.archive_set_gaps(t.raw("supplier").selectExpr("'/d/takeout-' || CAST(s_nationkey AS STRING) || '-' || lpad(CAST(s_suppkey % 50 AS STRING), 3, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.zip' ELSE '.tgz' END AS path")))

WANTED = "SELECT sha256 AS key, CASE WHEN size % 5 = 0 THEN CAST(size % 400 AS STRING) || '_' || CAST(size % 3 AS STRING) || '.jpg' ELSE CAST(size % 400 AS STRING) || '.jpg' END AS path FROM {files}"
TAKEN = "SELECT DISTINCT CASE WHEN size % 2 = 0 THEN CAST(size % 400 AS STRING) || '.jpg' ELSE CAST(size % 400 AS STRING) || '_' || CAST(size % 6 AS STRING) || '.jpg' END AS path FROM {files} WHERE size % 7 = 0"
query("w15_free_relative", f"""WITH w AS ({WANTED.format(files='files')}), tk AS ({TAKEN.format(files='files')}),
r AS (SELECT w.*, row_number() OVER (PARTITION BY w.path ORDER BY key) - 1 + CASE WHEN tk.path IS NULL THEN 0 ELSE 1 END r FROM w LEFT JOIN tk USING (path)),
u AS (SELECT path, replace(path, '.jpg', '') stem FROM (SELECT path FROM w UNION SELECT path FROM tk)),
n AS (SELECT DISTINCT path, r FROM r WHERE r > 0), f AS (SELECT path, k, row_number() OVER (PARTITION BY path ORDER BY k) r FROM (SELECT x.path, unnest(range(1, x.most + (SELECT count(*) FROM u WHERE starts_with(u.stem, replace(x.path, '.jpg', '') || '_')) + 1)) k FROM (SELECT path, max(r) most FROM n GROUP BY 1) x)
 WHERE replace(path, '.jpg', '') || '_' || CAST(k AS VARCHAR) NOT IN (SELECT stem FROM u))
SELECT r.key, r.path, CASE WHEN r.r = 0 THEN r.path ELSE replace(r.path, '.jpg', '') || '_' || CAST(f.k AS VARCHAR) || '.jpg' END AS free FROM r LEFT JOIN f ON f.path = r.path AND f.r = r.r""")(
    lambda t: on_drives.free_relative(t.spark.sql(WANTED, files=t.files), t.spark.sql(TAKEN, files=t.files)))
