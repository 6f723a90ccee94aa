"""Files in and out, and the incremental forms."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumibase import sources, streaming
from lumibase.operators import timeline


def test_listing_names_hidden_and_underscored(spark, tmp_path):
    for name in ("a.jpg", "_DSC0001.JPG", "sub/_MG_2.jpg", ".hid/x"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r.path.removeprefix(str(tmp_path) + "/"): r.kind for r in sources.read_listing(spark, [str(tmp_path)]).collect()}
    assert found == {"a.jpg": "file", "_DSC0001.JPG": "file", "sub": "dir", "sub/_MG_2.jpg": "file", ".hid": "hidden"}


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.jpg.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1408234464"}, "geoDataExif": {"latitude": 0, "longitude": 0}, "geoData": {"latitude": 1.5, "longitude": 2}, "description": " hi "}))
    (tmp_path / "b.json").write_text("{broken")
    rows = {r.name: r for r in sources.read_sidecars(spark, str(tmp_path)).collect()}
    assert (rows["a.jpg.json"].taken_at, rows["a.jpg.json"].lat, rows["a.jpg.json"].description) == (datetime(2014, 8, 17, 0, 14, 24), 1.5, "hi")
    assert rows["b.json"].taken_at is None


def test_decisions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d1", datetime(2024, 1, 1), "events", "k", "v"), ("d1", datetime(2024, 1, 1), "unknown", "k", "w"), ("d2", None, "events", "k", "x")], "drive_uuid string, written timestamp, section string, key string, value string")
    sources.write_decisions(rows, str(tmp_path / "docs"))
    assert sorted((r.drive_uuid, r.section, r.value) for r in sources.read_decisions(spark, str(tmp_path / "docs")).collect()) == [("d1", "events", "v"), ("d1", "unknown", "w"), ("d2", "events", "x")]


def test_run_record_and_metadata(spark, tmp_path):
    sources.write_run_record(spark.createDataFrame([(1, "a", "planned")], "run_id int, path string, status string"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    (tmp_path / "m.json").write_text('{"path": "a.jpg", "tags": {"Model": "X", "ImageWidth": 5, "Flash": "on", "Lens": [1, {"a": "ü"}]}}\n\n{"path": "b.jpg"}\n')
    row, bare = sorted(sources.read_metadata(spark, str(tmp_path / "m.json")).collect(), key=lambda r: r.path)
    assert (row.tags.Model, row.tags.ImageWidth, row.tags.Make) == ("X", 5, None) and bare.tags is None and bare.more is None
    assert row.more == {"Flash": '"on"', "Lens": '[1,{"a":"ü"}]'}


def run_stream(spark, tmp_path, rows, build, mode="append"):
    schema = "library bigint, sha256 string, captured_at timestamp"
    query = None
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table("out").collect()


def test_dedup_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    out = run_stream(spark, tmp_path, [[(1, "a", t), (1, "a", t)], [(1, "a", t + timedelta(hours=1)), (1, "b", t)]], streaming.dedup_stream)
    assert sorted(r.sha256 for r in out) == ["a", "b"]


def plain_islands(rows):
    """Rows with the number of their island: a gap of over two days ends one."""
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        number, at = last.get(r[0], (0, r[2]))
        last[r[0]] = (number + (r[2] - at > timedelta(hours=48)), r[2])
        out.append((r, last[r[0]][0]))
    return out


def test_closed_events_are_the_batch_operators(spark, tmp_path):
    """Events of closed islands by the stream, with places and rows out of order within the delay, equal those of the
    batch operator on each island; what is open stays, and no more."""
    import random

    from lumibase.streaming import runs

    rng, rows = random.Random(8), []
    for library in range(4):
        at = datetime(2024, 1, 1)
        for n in range(220):
            at += timedelta(seconds=rng.choice([5, 60, 600, 4000, 30_000, 200_000]) * rng.random())
            rows.append((library, f"{library}-{n}", at, *(rng.choice([(None, None), (10.0, 10.0), (12.0, 10.0)]) if n > 100 else (10.0, None))))
    rows.sort(key=lambda r: r[2])
    for n in range(0, len(rows) - 2, 7):  # a neighbour's place within the hour
        if rows[n + 1][2] - rows[n][2] < timedelta(minutes=50):
            rows[n], rows[n + 1] = rows[n + 1], rows[n]
    schema = "library bigint, sha256 string, captured_at timestamp, lat double, lon double"
    step = -(-len(rows) // 5)
    runs.arrived([spark.createDataFrame(rows[n : n + step], schema) for n in range(0, len(rows), step)], str(tmp_path / "in"))
    stream = runs.files(spark, spark.createDataFrame([], schema).schema, str(tmp_path / "in"))
    writer = runs.to_files(streaming.event_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    with runs.rocks_store(spark):
        runs.run(writer, batches=2)
        assert runs.run(writer) < 5
    got = sorted((r.library, r.files, r.start, r.end, r.lat and round(r.lat, 6), r.signature) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    final = max(r[2] for r in rows) - timedelta(hours=1)
    islands = plain_islands(rows)
    ends = {}
    for r, island in islands:
        ends[r[0], island] = max(r[2], ends.get((r[0], island), r[2]))
    closed = [(r[0] * 1000 + island, r[1], r[2], *r[3:]) for r, island in islands if ends[r[0], island] + timedelta(hours=48) < final]
    want = timeline.cluster_events(spark.createDataFrame(closed, schema))
    assert got == sorted((r.library // 1000, r.files, r.start, r.end, r.lat and round(r.lat, 6), r.signature) for r in want.collect()) and len(got) > 5
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "spans").load()
    open_days = {(r[0], r[2].date()) for r, island in islands if ends[r[0], island] + timedelta(hours=48) >= final}
    assert held.count() == len(open_days)


def test_session_events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[(1, f"{n}", t + timedelta(minutes=n)) for n in range(9)], [(1, "z", t + timedelta(days=9))], [(1, "y", t + timedelta(days=30))]]
    out = run_stream(spark, tmp_path, rows, streaming.session_events)
    assert [r.files for r in out] == [9]


def test_late_rows(spark):
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 9)), (2, datetime(2020, 1, 1))], "library int, captured_at timestamp_ntz")
    until = spark.createDataFrame([(1, datetime(2024, 1, 5))], "library int, until timestamp_ntz")
    now, late = streaming.late_rows(batch, until)
    assert (now.count(), late.count()) == (2, 1)


def test_ingest_batch_is_idempotent(spark, tmp_path):
    run = streaming.ingest_batch(str(tmp_path / "catalog"))
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "sha256 string")
    for _ in range(2):
        run(batch, 0)
    run(batch.union(spark.createDataFrame([("c",)], "sha256 string")), 1)
    run(batch.union(spark.createDataFrame([("c",)], "sha256 string")), 1)
    assert sorted(r.sha256 for r in spark.read.parquet(str(tmp_path / "catalog")).select(F.col("sha256")).collect()) == ["a", "b", "c"]


def test_ingest_stream_labels_and_dates(spark, tmp_path):
    schema = f"sha256 string, name string, {sources.METADATA_SCHEMA.removeprefix('path string, ')}"
    batches = [
        [("a", "IMG-20240102-WA0020.jpg", {}), ("b", "x.jpg", {"Model": "SM-A546B", "DateTimeOriginal": "2020:05:06 07:08:09"})],
        [("a", "again.jpg", {}), ("c", "x.bin", None), ("d", "IMG_20240102_120000.jpg", None)],
    ]
    for n, rows in enumerate(batches):
        path = tmp_path / "in" / f"{n}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(json.dumps({"sha256": s, "name": m, "tags": t}) for s, m, t in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(streaming.ingest_batch(str(tmp_path / "catalog"))).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
    rows = {r.sha256: r for r in spark.read.parquet(str(tmp_path / "catalog")).collect()}
    assert spark.read.parquet(str(tmp_path / "catalog")).count() == 4
    got = {s: (r.label, r.rule, r.captured_at and r.captured_at.date().isoformat(), r.date_source, r.batch) for s, r in rows.items()}
    assert got == {
        "a": ("WhatsApp", "filename_convention", None, "none", 0),  # a messenger's name tells when it was sent
        "b": ("Camera", "device", "2020-05-06", "exif", 0),
        "c": ("Saved", "fallback", None, "none", 1),
        "d": ("Camera", "camera_filename", "2024-01-02", "filename", 1),
    }


def test_corrections_equal_the_batch(spark):
    """Late rows in several batches, some of which merge and split events, give the timeline of all rows at once, and
    few rows are read again."""
    import random

    from lumibase.streaming import corrections

    rng, rows = random.Random(5), []
    for library in range(3):
        at = datetime(2020, 1, 1)
        for n in range(700):
            at += timedelta(seconds=rng.choice([5, 60, 600, 4000, 30_000, 90_000]) * rng.random())
            place = rng.choice([None, (10.0, 10.0), (10.0, 10.1)]) if n % 90 else (12.0, 10.0)
            rows.append((library, library * 10_000 + n, f"{library}-{n:04}", at, *(place or (None, None))))
    schema = "library bigint, key bigint, sha256 string, captured_at timestamp_ntz, lat double, lon double"
    late = [r for n, r in enumerate(rows) if n % 650 in (3, 4, 300)]
    df = lambda part: spark.createDataFrame(part, schema)
    state = corrections.cluster(df([r for r in rows if r not in late]))
    before = state.events()
    names = {r.signature for r in before.collect()}
    for part in (late[:3], late[:5], [(9, 1, "new library", datetime(2021, 1, 1), None, None), (0, 2, "undated", None, None, None)], late[5:]):
        found = corrections.correct(state, df(part))
        assert found.reread.count() < 600
        state = found.timeline
        for r in found.changes.collect():
            (names.add if r.change == "new" else names.remove)(r.signature)
    want = timeline.cluster_events(df(rows))
    key = lambda r: (r.library, r.files, r.start, r.end, r.signature)
    assert sorted(map(key, state.events().collect())) == sorted(map(key, want.collect()))
    assert names == {r.signature for r in want.collect()} and state.rows.count() == len(rows) + 1
    assert sorted(map(tuple, state.days.collect())) == sorted(map(tuple, df([*rows, (9, 1, "", datetime(2021, 1, 1), None, None)]).groupBy("library", F.to_date("captured_at")).count().collect()))
    assert corrections.correct(state, df([])).changes.count() == 0


def test_documents_go_through_unchanged(spark, tmp_path):
    """A document with all named sections, entries with fields of their own, and sections that nothing here knows."""
    from lumibase.sources import documents

    whole = {
        "captions": [{"sha256": "a", "text": "uñí \"x\""}, 5, None], "format": 1, "future": {"deep": {"n": 1.5, "yes": True}}, "written": "2024-05-01T10:00:00",
        "drive": {"uuid": "d1", "label": "Blue", "notes": None}, "settings": {"layout": "year", "theme": "dark"},
        "trips": [{"name": "Goa", "days": ["2014-08-14", "2014-08-15"], "cover": {"sha256": "q"}}, {"name": "B", "days": []}],
        "events": [{"signature": "s2", "name": "Party"}, {"signature": "s1", "name": "Zoo", "mood": [1, 2]}], "skipped_clusters": ["c2", "c1"],
        "date_confirmations": [{"sha256": "a", "captured_at": "2011-01-01T00:00:00", "confirmed_at": "2024-01-01"}], "albums": [{"name": "Best", "members": ["a"]}],
    }
    bare = {"drive": {"uuid": "d2"}, "events": "not a list", "settings": None}
    (tmp_path / "in").mkdir()
    for name, text in (("a", json.dumps(whole)), ("b", json.dumps(bare)), ("c", "{broken"), ("d", "[1]"), ("e", json.dumps({"drive": {"uuid": "d3"}, "settings": {"path_hint.x": "/home", "layout": "a/b"}}))):
        (tmp_path / "in" / f"{name}.json").write_text(text)
    rows = documents.read_documents(spark, str(tmp_path / "in"))
    assert sorted(r.key for r in rows.where("drive_uuid = 'd1' AND section = 'events'").collect()) == ["s1", "s2"]
    documents.write_documents(rows, str(tmp_path / "out"))
    found = {p.name.removeprefix("drive="): json.loads("".join(f.read_text() for f in p.glob("part-*"))) for p in (tmp_path / "out").glob("drive=*")}
    assert found["d1"] == whole and set(found) == {"d1", "d2", "d3"}
    empty = {"format": 1, "written": "", "trips": [], "events": [], "skipped_clusters": [], "date_confirmations": [], "albums": []}
    assert found["d2"] == empty | {"drive": {"uuid": "d2", "label": None, "notes": None}, "settings": {}}
    assert found["d3"]["settings"] == {"layout": "a/b"}
    again = documents.read_documents(spark, str(tmp_path / "out" / "drive=*"))
    text = lambda df: sorted((r.drive_uuid, str(r.section), str(r.key), str(r.item)) for r in df.select("drive_uuid", "section", "key", F.to_json("item").alias("item")).collect())
    assert text(again) == [r for r in text(rows) if "path_hint" not in r[2]]


class CountedState:
    """A list state, and the handle of a processor that has only such, which count their calls."""

    calls = 0

    def __init__(self):
        self.kept, self.timers, self.lists = [], set(), {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, CountedState())

    def get(self):
        CountedState.calls += 1
        return iter(self.kept)

    def put(self, rows):
        CountedState.calls += 1
        self.kept = list(rows)

    def appendList(self, rows):
        CountedState.calls += 1
        self.kept += rows

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        CountedState.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        CountedState.calls += 1
        self.timers.remove(at)


def test_calls_to_the_state_do_not_grow_with_the_days():
    """a batch of a library with rows on many days is a handful of calls, and so is closing its islands."""
    from types import SimpleNamespace

    import pandas as pd

    islands, handle = streaming.EventIslands(), CountedState()
    islands.init(handle)
    day = streaming.DAY
    at = [n * day + m * 60_000_000 for n in (*range(12), *range(20, 30)) for m in range(9)]
    frame = pd.DataFrame({"at": at, "sha256": [f"{n:04}" for n in range(len(at))], "lat": None, "lon": None})
    for part in (frame[:50], frame[50:]):
        CountedState.calls = 0
        assert list(islands.handleInputRows((1,), iter([part]), None)) == [] and CountedState.calls <= 6
    assert len(handle.timers) == 2 and len(handle.lists["spans"].kept) == 22
    CountedState.calls, first = 0, min(handle.timers)
    due = lambda until: list(islands.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: until), SimpleNamespace(getExpiryTimeInMs=lambda: until)))
    [out] = due(first)
    assert out["files"].sum() == 12 * 9 and CountedState.calls <= 4 and len(handle.lists["spans"].kept) == 10
    assert due(first) == []
    [out] = due(max(handle.timers))
    assert out["files"].sum() == 10 * 9 and handle.lists["rows"].kept == [] and handle.lists["spans"].kept == []


def test_parts_of_a_stream_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """no part of a table goes through one task."""
    from lumibase.plans import library, registry

    monkeypatch.setattr(library, "fresh_path", lambda spark, label: str(tmp_path / label))
    assert registry.QUERIES["r1_ingest_stream"](spark, "/root/testdata/sf0.001").count() > 0
    written = [len(list((tmp_path / "ingested" / "in" / str(n)).glob("part-*"))) for n in range(3)]
    assert min(written) > 1
