"""Operators against brute force and small examples; every one also over empty tables."""

import random
import re
import unicodedata
from datetime import datetime, timedelta

import pytest
from oracle import compare
from pyspark.sql import functions as F

from lumibase.operators import catalog, copies, duplicates, sidecars, timeline
from lumibase.plans.registry import ORACLES


def brute(rows, threshold):
    """The one-by-one loop over (seq, sha, signature)."""
    seen, index, out = {}, [], {}
    for seq, sha, sig in rows:
        kind = match = distance = None
        if sha is not None and sha in seen:
            kind, match = "exact", seen[sha]
        else:
            best = min(((bin((sig ^ s) & (2**64 - 1)).count("1"), q) for q, s in index if sig is not None), default=(99, None))
            if best[0] <= threshold:
                kind, (distance, match) = "near", best
            if sha is not None:
                seen.setdefault(sha, seq)
            if sig is not None:
                index.append((seq, sig))
        out[seq] = (kind or "unique", match, distance)
    return out


@pytest.mark.parametrize("threshold", [0, 1, 5, 8, 9, 12, 15])
def test_resolve_equals_the_loop(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for n in range(160):
        sig = rng.choice(base)
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            sig ^= 1 << bit
        sig = None if rng.random() < 0.1 else sig - (1 << 64) if sig >> 63 else sig
        rows.append((f"p{n:03}", None if rng.random() < 0.1 else f"s{rng.randint(0, 90)}", sig))
    want = brute(rows, threshold)
    df = spark.createDataFrame(rows, "path string, sha256 string, perceptual bigint")
    got = {r.path: (r.kind, r.match_path, r.distance) for r in duplicates.resolve(df.where("path < 'p060'"), df.where("path >= 'p060'"), threshold).collect()}
    assert got == {p: want[p] for p in got} and len(got) == 100


def test_few_signatures_with_many_keys_are_many_tasks(spark):
    """a table that is one task before its keys is dealt over tasks for them."""
    one = spark.range(10).select(F.col("id").alias("perceptual")).coalesce(1)
    assert duplicates._dealt(one, 10, 56).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert duplicates._dealt(one, 3_000_000, 56).rdd.getNumPartitions() == 168


def test_bands_refuse_large_thresholds():
    with pytest.raises(ValueError):
        duplicates.pieces(9, 1)


def items(spark, times, library=1):
    return spark.createDataFrame([(library, f"s{n:04}", t, None, None, None) for n, t in enumerate(times)], "library int, sha256 string, captured_at timestamp_ntz, lat double, lon double, event_id int")


def test_bursts_and_trips(spark):
    start = datetime(2014, 8, 14, 10)
    times = [start + timedelta(days=d, minutes=m) for d, n in enumerate((31, 45, 60, 12)) for m in range(n)]
    rows = items(spark, times)
    events = timeline.cluster_events(rows)
    assert sorted(r.files for r in events.collect()) == [12, 31, 45, 60]
    trip = timeline.detect_trips(rows, events).collect()
    assert [(str(t.start_date), str(t.end_date), t.files, t.outcome) for t in trip] == [("2014-08-14", "2014-08-17", 148, "proposed")]
    assert [r.kind for r in timeline.review_cards(timeline.detect_trips(rows, events), events, rows).collect()] == ["trip"]


def test_year_splits_a_run(spark):
    times = [datetime(2014, 12, 31, 10) + timedelta(days=d, minutes=m) for d in range(2) for m in range(10)]
    rows = items(spark, times)
    assert timeline.detect_trips(rows, timeline.cluster_events(rows)).count() == 0


def test_places_end_an_event(spark):
    rows = items(spark, [datetime(2020, 1, 1, 10, m) for m in range(20)]).withColumns({"lat": F.when(F.col("sha256") < "s0010", 0.0).otherwise(10.0), "lon": F.lit(0.0)})
    assert sorted(r.files for r in timeline.cluster_events(rows).collect()) == [10, 10]


def test_free_relative(spark):
    wanted = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "b.jpg"), (4, "a_1.jpg")], "key int, path string")
    taken = spark.createDataFrame([("b.jpg",)], "path string")
    free = {r.key: r.free for r in copies.free_relative(wanted, taken).collect()}
    assert free[1] == "a.jpg" and free[3] == "b_1.jpg" and len(set(free.values())) == 4


def test_empty_tables(spark):
    none = items(spark, [])
    events = timeline.cluster_events(none)
    assert events.count() == 0 and timeline.detect_trips(none, events).count() == 0
    df = spark.createDataFrame([], "path string, sha256 string, perceptual bigint")
    assert duplicates.resolve(df, df).count() == 0
    assert copies.verify_copies(spark.createDataFrame([], "sha256 string, drive_uuid string, relative string, copy_sha256 string"), spark.createDataFrame([], "drive_uuid string, relative string, digest string")).count() == 0


def test_custody_freshness_names_every_drive(spark):
    drives = spark.range(30).selectExpr("CAST(id AS STRING) AS uuid", "'drive ' || lpad(CAST(id AS STRING), 2, '0') AS label")
    copies_ = spark.range(60).selectExpr("CAST(id AS STRING) AS sha256", "CAST(id % 30 AS STRING) AS drive_uuid", "1L AS size", "CASE WHEN id % 30 = 7 OR id < 30 THEN timestamp_ntz'2004-12-01 00:00:00' END AS last_verified", "CAST(NULL AS timestamp_ntz) AS missing_at")
    row = catalog.custody_freshness(drives, copies_, "2005-01-01 00:00:00").first()
    assert row.never_checked == 29 and row.never_checked_names.split(";") == [f"drive {n:02}" for n in range(30) if n != 7]
    assert (row.age_days, row.tier) == (31, "softening")


def test_rederive_query_reads_tags(spark):
    rows = library_queries()["j26_rederive"](spark, "/root/testdata/sf0.001")
    assert {"device", "software", "screenshot_metadata", "fallback"} <= {r.rule for r in rows.select("rule").distinct().collect()}
    assert rows.count() == library_queries()["j26_rederive"](spark, "/root/testdata/sf0.001").count()


def test_rederive_sql_reads_no_time_into_longer_numbers(spark, tmp_path):
    """Names end in an order's number: six digits may be a time, seven are none (F1)."""
    orders = ("timestamp_ntz'1997-03-04 00:00:00' AS o_orderdate", "'F' AS o_orderstatus", "1000.5D AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    spark.createDataFrame([(n, 1 + 20 * k) for k, n in enumerate((120000, 999999, 1200000, 2359590))], "o_orderkey bigint, o_custkey bigint").selectExpr("*", *orders).coalesce(1).write.parquet(str(tmp_path / "written"))
    [part] = (tmp_path / "written").glob("*.parquet")
    part.rename(tmp_path / "orders.parquet")
    assert compare(spark, str(tmp_path), library_queries()["j26_rederive"], ORACLES["j26_rederive"]) == ""
    rules = {int(r.sha256): r.rule for r in library_queries()["j26_rederive"](spark, str(tmp_path)).collect()}
    assert rules[120000] == "camera_filename" and "camera_filename" not in (rules[999999], rules[1200000], rules[2359590])


def test_sanitize_whole_values_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"

    def tail(value):
        return re.sub(r"[ .]+$", "", value.strip(" "))

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        clean = tail(re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", r.text))
        want[r.doc_id] = tail(unicodedata.normalize("NFC", clean).encode()[:255].decode(errors="ignore"))
    found = {r.doc_id: r.value for r in library_queries()["f19_sanitize_value"](spark, sf).collect()}
    assert found == want and max(len(v.encode()) for v in found.values()) == 255


def test_merged_cards_of_all_users(spark):
    sf = "/root/testdata/sf0.001"
    cards = library_queries()["w8_merge_cards"](spark, sf)
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert cards.select("library").distinct().count() == users
    assert {r.error for r in cards.select("error").distinct().collect()} == {None, "over_span"}


def library_queries():
    from lumibase.plans import library, registry  # noqa: F401

    return registry.QUERIES


def test_free_relative_takes_the_least_free_number(spark):
    def free(wanted, taken):
        w = spark.createDataFrame(list(enumerate(wanted)), "key int, path string")
        found = copies.free_relative(w, spark.createDataFrame([(p,) for p in taken], "path string")).collect()
        assert sorted((r.key, r.path) for r in found) == list(enumerate(wanted))
        return [r.free for r in sorted(found)]

    assert free(["a.jpg"], ["a.jpg", "a_1.jpg"]) == ["a_2.jpg"]
    assert free(["a.jpg"], ["a.jpg", "a_1.jpg", "a__1.jpg", "a___1_1.jpg"]) == ["a_2.jpg"]
    assert free(["a.jpg", "a.jpg", "a.jpg"], ["a_1.jpg", "a_3.jpg"]) == ["a.jpg", "a_2.jpg", "a_4.jpg"]
    assert free(["x/b", "x/b", "y/b", "x/b.c/d", "x/b.c/d"], ["y/b"]) == ["x/b", "x/b_1", "y/b_1", "x/b.c/d", "x/b.c/d_1"]
    assert free(["a.jpg", "a.jpg", "a_1.jpg", "a_1.jpg"], []) == ["a.jpg", "a_2.jpg", "a_1.jpg", "a_1_1.jpg"]
    assert free([".hid", ".hid"], []) == [".hid", ".hid_1"] and free([], ["a"]) == []


def test_free_relative_equals_the_loop(spark):
    """Against the one-by-one search, where no path that is asked for is a number of another."""
    rng = random.Random(7)
    wanted = [f"{rng.choice('ab')}/{rng.choice('cd')}{rng.choice(['.jpg', '', '.x.png'])}" for _ in range(150)]
    taken = {f"{rng.choice('ab')}/{rng.choice('cd')}{rng.choice(['', '_1', '_2', '_5', '_07', '_30'])}{rng.choice(['.jpg', '', '.x.png'])}" for _ in range(25)}
    have, want = set(taken), []
    for path in wanted:
        folder, name = path.rsplit("/", 1)
        stem, dot, suffix = name.rpartition(".")
        stem, suffix = (stem, dot + suffix) if dot else (name, "")
        free, n = path, 0
        while free in have:
            n += 1
            free = f"{folder}/{stem}_{n}{suffix}"
        have.add(free)
        want.append(free)
    found = copies.free_relative(spark.createDataFrame(list(enumerate(wanted)), "key int, path string"), spark.createDataFrame([(p,) for p in taken], "path string"))
    assert [r.free for r in sorted(found.collect())] == want


def test_totals_of_undated_and_uncopied_files(spark):
    files = spark.createDataFrame([("a", 1, "Camera", datetime(2020, 1, 1)), ("b", 2, "Camera", None), ("c", 3, "Adobe", datetime(2021, 1, 1))], "sha256 string, size bigint, category string, captured_at timestamp_ntz")
    held = spark.createDataFrame([("a", "d", None, datetime(2022, 1, 1)), ("c", "d", None, None)], "sha256 string, drive_uuid string, missing_at timestamp_ntz, last_verified timestamp_ntz")
    r = catalog.stats_summary(files, held).first()
    assert (r.timeline, r.side_bin, r.undated, r.never_verified, r.on_no_drive) == (1, 2, 1, 2, 1)


def test_reclaim_asks_what_the_copy_hashes_to_now(spark):
    rows = [("a", "a.jpg", "da", "/s/a"), ("b", "b.jpg", None, "/s/b"), ("c", "c.jpg", "dc", "/s/c"), ("d", "d.jpg", "dd", "/s/d"), ("e", "e.jpg", "de", "/s/e")]
    candidates = spark.createDataFrame([(*r, 9, datetime(2020, 1, 1), 1 if r[0] == "e" else 2) for r in rows], "sha256 string, relative string, copy_sha256 string, source_path string, size bigint, last_verified timestamp_ntz, copies bigint")
    listing = spark.createDataFrame([(f"/s/{c}",) for c in "abcde"], "path string")
    observed = spark.createDataFrame([("a.jpg", "da"), ("b.jpg", "db"), ("c.jpg", "other"), ("e.jpg", "de")], "relative string, digest string")
    found = {r.bucket: r.files for r in catalog.reclaim_plan(candidates, listing, observed, "/drive/", 2).collect()}
    assert found == {"candidate": 1, "unverified": 3, "below_min_copies": 1}


def test_confirmations_tie_to_the_newest_document_then_the_smaller_drive(spark):
    from lumibase.operators import decisions

    day = datetime(2020, 1, 1)
    rows = [("2", day, "a", "x", 5), ("1", day, "a", "y", 5), ("3", None, "a", "z", 5), ("9", day, "b", "old", 1), ("1", None, "b", "new", 2)]
    df = spark.createDataFrame(rows, "drive_uuid string, written timestamp_ntz, sha256 string, captured_at string, confirmed_at int")
    assert {r.sha256: r.captured_at for r in decisions.merge_confirmations(df).collect()} == {"a": "y", "b": "new"}
    settings = spark.createDataFrame([("1", day, "path_hint.a", "v"), ("1", day, "decisions.b", "v"), ("1", day, "catalog.c", "v"), ("1", day, "window.d", "v")], "drive_uuid string, written timestamp_ntz, key string, value string")
    assert [r.key for r in decisions.merge_settings(settings).collect()] == ["window.d"]


def test_presets(spark):
    from lumibase.functions import paths

    row = spark.range(1).select(F.lit(datetime(2020, 3, 4)).cast("timestamp_ntz").alias("at"), F.lit("x").alias("c"))
    folder = lambda preset, kind: row.select(paths.PRESETS[preset].folder(F.lit(kind), F.col("at"), F.col("c"), F.lit("E"), F.lit("T"), composed=True)).first()[0]
    assert folder("year-month-event", "everyday") == "2020/2020-03/2020-03 - Everyday" and folder("year-month-event", "event_day") == "2020/2020-03/E"
    assert folder("year-event", "everyday") == "2020/2020-03" and folder("year-event", "event_day") == "2020/E" and folder("year-event", "trip_day") == "2020/T/2020-03-04"
    assert folder("year-month-day", "everyday") == "2020/2020-03/2020-03-04" and folder("year-month-day", "side_bin") == "x/2020/2020-03"
    with pytest.raises(ValueError):
        paths.Scheme(event="{category}/{yyyy}")


def plain_segments(times, places, by=timeline.Clustering()):
    """W1 as a loop over one library's rows in order."""
    import math
    import statistics

    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    logs = [math.log1p(max(g, 0)) for g in gaps]
    out, segment = [], 0
    for n in range(len(times)):
        out.append(segment)
        if n == len(times) - 1:
            break
        around = logs[max(0, n - 10) : n] + logs[n + 1 : n + 11]
        far = False
        if places[n] and places[n + 1]:
            (a, c), (b, d) = places[n], places[n + 1]
            a, b, c, d = map(math.radians, (a, b, c, d))
            far = 2 * 6371.0088 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((d - c) / 2) ** 2)) > by.jump_km
        if gaps[n] > by.most_gap_s or (gaps[n] >= by.least_gap_s and around and logs[n] - statistics.median(around) > by.sensitivity) or far:
            segment += 1
    return out


@pytest.mark.parametrize("blocks", [None, 7, 150])
def test_segments_over_blocks_equal_the_loop(spark, blocks):
    """Also over so many blocks that a row's neighbours lie several blocks away; undated rows are left out."""
    rng = random.Random(3)
    rows = []
    for library in range(6):
        at = datetime(2020, 1, 1)
        for n in range(160):
            at += timedelta(seconds=rng.choice([5, 60, 600, 4000, 30_000, 90_000, 400_000]) * rng.random())
            place = rng.choice([None, (10.0, 10.0), (10.0, 10.1), (12.0, 10.0)])
            rows.append((library, f"{library}-{n:04}", at, *(place or (None, None)), None))
    undated = [(0, "undated", None, None, None, None)] * 3
    df = spark.createDataFrame(rows + undated, "library int, sha256 string, captured_at timestamp_ntz, lat double, lon double, event_id int").repartition(5)
    found = timeline.segments(df, blocks=blocks).collect()
    got = {r.sha256: r.segment for r in found}
    assert len(found) == len(rows)
    for library in range(6):
        own = [r for r in rows if r[0] == library]
        assert [got[r[1]] for r in own] == plain_segments([r[2] for r in own], [r[3:5] if r[3] is not None else None for r in own])


def test_one_moment_is_many_blocks(spark):
    """All rows of a library at one reset clock, and a few before and behind: as many tasks as blocks, one event."""
    reset = datetime(1999, 12, 31)
    rows = [(1, f"{n:05}", reset, None, None) for n in range(3000)] + [(1, f"x{n}", reset + timedelta(days=300, seconds=n), None, None) for n in range(20)]
    df = spark.createDataFrame(rows, "library int, sha256 string, captured_at timestamp_ntz, lat double, lon double")
    placed = timeline.in_blocks(df, 8)
    sizes = [r["count"] for r in placed.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert sorted(r.files for r in timeline.cluster_events(df).collect()) == [20, 3000]


@pytest.mark.parametrize("blocks", [None, 9])
def test_scans_of_one_group_are_many_blocks(spark, blocks):
    """A group of most rows, small groups, a null group and null sizes, against one window for a group."""
    rng = random.Random(6)
    rows = [(rng.choice(["big"] * 8 + ["b", "c", None]), n, rng.choice([None, *range(50)])) for n in range(1500)] + [("one", 0, None), ("two", 1, 4), ("two", 2, None)]
    df = spark.createDataFrame(rows, "g string, at int, size int").repartition(4)
    groups = {g: sorted(r for r in rows if r[0] == g) for g in {r[0] for r in rows}}
    want = []
    for own in groups.values():
        for n, r in enumerate(own):
            left = [x[2] for x in own[n:] if x[2] is not None]
            want.append((*r, max(left, default=None)))
    got = timeline.suffix_max(df, "g", "at", "size", blocks)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    sample = [tuple(r) for r in timeline.stride_sample(df, "g", "at", 40, blocks).collect()]
    wanted = [r for own in groups.values() for r in (own if len(own) <= 40 else [own[j * len(own) // 40] for j in range(40)])]
    assert sorted(sample, key=key) == sorted(wanted, key=key) and sum(r[0] == "big" for r in sample) == 40
    if blocks:
        placed = timeline._scanned(df.where("g = 'big'"), "g", "at", "x", blocks)
        assert placed.select("_block").distinct().count() == blocks


def test_numbered_equals_row_number(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), datetime(2020, 1, rng.randint(1, 9), rng.randint(0, 23)), n) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id int")
    got = {r.id: r.n for r in timeline.numbered(df, ["k"], F.to_date("at"), ["at", "id"]).collect()}
    for k in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_links_by_any_number_of_pieces_equal_brute_force(spark, agree):
    rng = random.Random(agree)
    sigs = {0, -1}
    for _ in range(20):
        s = rng.getrandbits(64)
        for _ in range(6):
            sigs.add(s - (1 << 64) if s >> 63 else s)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                s ^= 1 << bit
    found = {(r.a, r.b): r.distance for r in duplicates.signature_links(spark.createDataFrame([(s,) for s in sigs], "perceptual bigint"), 5, agree).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert found == {(a, b): near(a, b) for a in sigs for b in sigs if a != b and near(a, b) <= 5}
    assert duplicates.cheapest_agree(5, 10**3) < duplicates.cheapest_agree(5, 10**9)


@pytest.mark.parametrize("threshold", [9, 12, 15])
def test_wide_links_equal_brute_force(spark, threshold):
    """Signatures at all distances around the radius; all ways to cut give the same pairs, none of them twice."""
    rng = random.Random(threshold)
    sigs = {0, -1}
    for _ in range(12):
        s = rng.getrandbits(64)
        for _ in range(14):
            t = s
            for bit in rng.sample(range(64), rng.randint(0, threshold + 2)):
                t ^= 1 << bit
            sigs.add(t - (1 << 64) if t >> 63 else t)
    df = spark.createDataFrame([(s,) for s in sigs], "perceptual bigint")
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b): near(a, b) for a in sigs for b in sigs if a != b and near(a, b) <= threshold}
    rows = duplicates.signature_links(df, threshold).collect()
    assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want)
    for count in (4, 5, 6):
        pairs = [(r.a, r.b) for r in duplicates.flipped_pairs(df, threshold, count).collect()]
        assert len(pairs) == len(set(pairs)) and set(want) <= set(pairs) and len(pairs) < len(sigs) ** 2 / 2
    with pytest.raises(ValueError):
        duplicates.signature_links(df, 16)


def test_the_date_ladder_is_a_small_plan(spark):
    from lumibase.plans.bindings import Tables
    from lumibase.functions import dates

    media = Tables(spark, "/root/testdata/sf0.001").media
    found = dates.with_capture_datetime(media, F.lit("2024-06-01").cast("timestamp_ntz"), taken="taken_at", out="r").select("id", "r.source", "r.value", "r.tag")
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 40_000


def test_upserts_take_the_new_row(spark):
    schema = "sha256 string, captured_at timestamp_ntz, date_source string, date_tag string, size bigint"
    day = datetime(2014, 8, 17)
    files = spark.createDataFrame([("a", day, "exif", "DateTimeOriginal", 5), ("b", day, "exif", "CreateDate", 6), ("c", day, "exif", None, 7)], schema)
    incoming = spark.createDataFrame([("a", None, "none", None, None), ("c", None, "none", None, 8), ("d", day, "filename", None, 9), ("d", day, "filename", None, 10)], schema)
    sure = spark.createDataFrame([("c", datetime(2011, 1, 1))], "sha256 string, captured_at timestamp_ntz")
    rows = {r.sha256: tuple(r)[1:] for r in catalog.upsert_files(files, incoming, sure, order="size").collect()}
    assert rows == {"a": (None, "none", None, None), "b": (day, "exif", "CreateDate", 6), "c": (datetime(2011, 1, 1), "human_confirmed", None, 8), "d": (day, "filename", None, 10)}
    schema = "sha256 string, drive_uuid string, relative string, copy_sha256 string, size bigint, last_verified timestamp_ntz, missing_at timestamp_ntz, date_baked_at timestamp_ntz"
    copies_ = spark.createDataFrame([("a", "1", "x", "old", 5, day, day, day), ("a", "2", "y", "old", 5, day, day, day)], schema)
    again = spark.createDataFrame([("a", "1", "z", None, 6, None, day, None), ("b", "1", "w", "new", 1, day, day, day)], schema)
    rows = {(r.sha256, r.drive_uuid): tuple(r)[2:] for r in catalog.upsert_copies(copies_, again).collect()}
    assert rows == {("a", "1"): ("z", None, 6, day, None, day), ("a", "2"): ("y", "old", 5, day, day, day), ("b", "1"): ("w", "new", 1, None, None, None)}


def test_adoption(spark):
    """Against the loop: a stride of the records, a stride of three of those that are there, and all of them at once."""
    rng = random.Random(12)
    copies_, listing, digests = [], [], []
    for drive in range(8):
        for n in range(rng.choice([0, 2, 30, 41, 90, 133])):
            path, sha = f"{drive}/{n:03}", f"s{drive}-{n}"
            copies_.append((str(drive), path, sha, None if n % 5 == 0 else f"baked-{sha}"))
            here = drive in (1, 2) or rng.random() < (0.9 if drive % 2 else 0.45)
            refused = not here and drive == 4 and rng.random() < 0.9
            if here or refused:
                listing.append((path, refused))
            if here:
                digests.append((path, "other" if drive == 2 and n % 2 else (sha if n % 5 == 0 else f"baked-{sha}")))
    args = (spark.createDataFrame(copies_, "drive_uuid string, relative string, sha256 string, copy_sha256 string"), spark.createDataFrame(listing, "path string, refused boolean"), spark.createDataFrame(digests, "path string, digest string"))
    stride = lambda xs, n: xs if len(xs) <= n else [xs[i * len(xs) // n] for i in range(n)]
    there, seen, want = {p for p, r in listing if not r}, dict(digests), {}
    for drive in {c[0] for c in copies_}:
        own = {c[1]: c[3] or c[2] for c in copies_ if c[0] == drive}
        sample = stride(sorted(own), 40)
        present = [p for p in sample if p in there]
        refused = sum(p in {q for q, r in listing if r} for p in sample)
        probed = stride(present, 3)
        agreed = sum(seen[p] == own[p] for p in probed)
        if len(present) < len(sample) / 2:
            verdict = "unreadable" if len(present) + refused >= len(sample) / 2 else "no_match"
            probed, agreed = [], 0
        else:
            verdict = "proven" if agreed and agreed == len(probed) else "content_differs"
        same = {p: d for p, d in own.items()} == {p: d for p, d in seen.items() if p.startswith(f"{drive}/")}
        want[drive] = (len(sample), len(present), refused, len(probed), agreed, verdict, same)
    got = {r.drive_uuid: (r.sampled, r.present, r.refused, r.probed, r.agreed, r.verdict) for r in copies.adoption_verdict(*args).collect()}
    assert got == {d: w[:-1] for d, w in want.items()} and len({w[5] for w in want.values()}) >= 3
    for drive in want:  # the tree of one drive, as a whole
        whole = {r.drive_uuid: r.exact for r in copies.adoption_verdict(args[0], args[1], args[2].where(F.col("path").startswith(f"{drive}/"))).collect()}
        assert whole[drive] == want[drive][-1] and not any(v for d, v in whole.items() if d != drive)


def test_cache_answers_what_is_asked(spark):
    listing = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, 10), ("d", 1, 10), ("e", 2, 10)], "path string, size int, mtime int")
    fp = copies.tag_fingerprint(["Model", "Make", "Model"])
    assert fp == copies.tag_fingerprint(["Make", "Model"]) != copies.tag_fingerprint(["Make"])
    rows = [("a", 1, 10, "s", True, fp, "{}"), ("b", 1, 11, "s", True, fp, "{}"), ("c", 1, 10, None, False, fp, "{}"), ("d", 1, 10, "s", False, "old", "{}")]
    cache = spark.createDataFrame(rows, "path string, size int, mtime int, sha256 string, perceptual_computed boolean, tags_fp string, tags string")
    reused = lambda **ask: {r.path for r in copies.cache_reuse(listing, cache, **ask).where("reused").collect()}
    assert reused() == {"a", "d"} and reused(want_sha=False) == {"a", "c", "d"} and reused(want_perceptual=True) == {"a"}
    assert reused(want_sha=False, tags=["Make", "Model"]) == {"a", "c"} and reused(tags=["Make", "Model", "Lens"]) == set()


def test_keys_cost_more_than_comparisons():
    assert duplicates.cheapest_agree(5, 12_000_000) == 2  # 21 keys a signature, where 56 were made


def test_sidecars_are_read_once_for_both_tiers(spark):
    keys = sidecars.sidecar_keys(spark.createDataFrame([("f", "a.jpg.supplemental-me(1).json"), ("f", "b.txt")], "folder string, name string"))
    assert "Union" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, keys.collect())) == [("f", "a.jpg.supplemental-me(1).json", 0, "a.jpg.supplemental-me(1)"), ("f", "a.jpg.supplemental-me(1).json", 1, "a.jpg(1)")]


def test_few_spans_of_many_rows_are_dealt(spark):
    from lumibase.operators.stages import dealt

    cores = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= cores
