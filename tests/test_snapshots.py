"""Tables of buckets: what an update touches, and what a failure at each step leaves."""

import pytest
from pyspark.sql import functions as F

from lumibase.operators import catalog
from lumibase.operators.recorded import Catalog
from lumibase.sources import snapshots
from lumibase.sources.snapshots import Conflict, Snapshots


def table(spark, path, n=200, buckets=16):
    made = Snapshots(spark, str(path))
    made.create(spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v")), ("k",), buckets)
    return made


def raised(keys, by):
    return lambda old: old.join(keys.select("k", F.lit(by).alias("d")), "k", "left").select("k", (F.col("v") + F.coalesce("d", F.lit(0))).alias("v"))


def values(made):
    return {r.k: r.v for r in made.read().collect()}


def files(made):
    return {f for f in made.read().inputFiles()}


def test_only_touched_buckets_change(spark, tmp_path):
    made = table(spark, tmp_path / "t")
    before, names = files(made), made.manifest().folders
    keys = spark.createDataFrame([("5",), ("17",)], "k string")
    assert made.update(keys, raised(keys, 1), "b1")
    touched = {str(r[0]) for r in keys.select(made.bucket(("k",), 16)).collect()}
    now = made.manifest()
    assert {n for n in now.folders if now.folders[n] != names[n]} == touched
    kept = {f for f in before if not any(f"_bucket={n}/" in f for n in touched)}
    assert kept and kept <= files(made)
    assert {k for k, v in values(made).items() if v} == {"5", "17"} and len(values(made)) == 200
    assert {r.v for r in made.read(0).collect()} == {0}


@pytest.mark.parametrize("fails", ["write", "switch"])
def test_a_retry_after_a_failure(spark, tmp_path, monkeypatch, fails):
    made = table(spark, tmp_path / "t")
    keys = spark.createDataFrame([("5",), ("300",)], "k string")
    change = lambda old: raised(keys, 1)(old.unionByName(spark.createDataFrame([("300", 0)], "k string, v int")))
    before, seen = values(made), files(made)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_switch" if fails == "switch" else "_written", broken)
        with pytest.raises(OSError):
            made.update(keys, change, "b1")
    assert values(made) == before and files(made) == seen
    assert made.update(keys, change, "b1") is True
    after = values(made)
    assert after == before | {"5": 1, "300": 1}
    assert made.update(keys, change, "b1") is False and values(made) == after and made.manifest().version == 1
    made.vacuum(1)
    assert values(made) == after and len(list((tmp_path / "t" / "manifests").glob("[0-9]*.json"))) == 1
    assert sum(1 for _ in (tmp_path / "t" / "data").glob("*/_bucket=*")) == len(made.manifest().folders)


def test_writers_at_the_same_time(spark, tmp_path):
    made = table(spark, tmp_path / "t")
    keys = spark.createDataFrame([("5",)], "k string")

    def other(old):
        Snapshots(spark, str(tmp_path / "t")).update(keys, raised(keys, 10), "other")
        return raised(keys, 1)(old)

    with pytest.raises(Conflict):
        made.update(keys, other, "b1")
    assert values(made)["5"] == 10
    assert made.update(keys, raised(keys, 1), "b1") and values(made)["5"] == 11
    with pytest.raises(Conflict):
        made.create(spark.range(1).selectExpr("'a' AS k", "1 AS v"), ("k",))


def test_odd_updates(spark, tmp_path):
    made = table(spark, tmp_path / "t", n=3)
    keys = spark.createDataFrame([(None,), ("1",), ("1",)], "k string")
    assert made.update(keys, lambda old: old.where("k IS DISTINCT FROM '1'").unionByName(spark.createDataFrame([(None, 7)], "k string, v int")))
    assert values(made) == {"0": 0, "2": 0, None: 7}
    assert made.update(keys.limit(0), lambda old: old) and len(values(made)) == 3
    with pytest.raises(ValueError):
        made.update(keys, lambda old: made.read())
    made.update(made.read(), lambda old: old.limit(0))
    assert values(made) == {} and made.manifest().folders == {}
    with pytest.raises(FileNotFoundError):
        Snapshots(spark, str(tmp_path / "none")).read()


def test_forgetting_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """The copies are gone and the files still there when it fails; the retry ends it."""
    files_ = spark.createDataFrame([("a", 1), ("b", 2)], "sha256 string, size int")
    copies = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "sha256 string, drive_uuid string")
    own = Catalog(spark, str(tmp_path / "c"), 4)
    own.create(files=files_, copies=copies)
    gone = copies.where("drive_uuid = '1'")
    switch = snapshots.Snapshots._switch

    def once(self, new):
        if self.path.endswith("files"):
            raise OSError("lost")
        switch(self, new)

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_switch", once)
        with pytest.raises(OSError):
            own.forget_content(gone, "b1")
    assert own.read("files").count() == 2 and own.read("copies").count() == 1
    assert own.forget_content(gone, "b1") is True and own.forget_content(gone, "b1") is False
    want = catalog.forget_content(files_, copies, gone)
    assert [sorted(map(tuple, own.read(n).collect())) for n in ("files", "copies")] == [sorted(map(tuple, df.collect())) for df in want]


def test_a_batch_is_read_once_and_not_dealt_by_bucket(spark, tmp_path):
    """what an update forgets or brings is evaluated once, and rows are written by the tasks that have them."""
    made = Snapshots(spark, str(tmp_path / "t"))
    made.create(spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("k")), ("k",), 2)
    assert {len(list((tmp_path / "t" / f).glob("part-*"))) for f in made.manifest().folders.values()} == {4}

    own, seen = Catalog(spark, str(tmp_path / "c"), 4), spark.sparkContext.accumulator(0)
    copies = spark.range(20).selectExpr("CAST(id AS STRING) AS sha256", "'d' AS drive_uuid", "timestamp_ntz'2004-01-01 00:00:00' AS last_verified", "CAST(NULL AS timestamp_ntz) AS missing_at", "1L AS size", "'r' AS relative")
    own.create(files=copies.select("sha256"), copies=copies)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    def batch(columns):
        rows = copies.where("sha256 < '15'").selectExpr(*columns)
        return rows.mapInPandas(counted, rows.schema)

    n = batch(["sha256"]).count()
    for update in (
        lambda b: own.upsert_copies(batch(["sha256", "drive_uuid", "size"]), b),
        lambda b: own.apply_verification(batch(["sha256", "drive_uuid", "'verified' AS outcome"]), "2005-01-01 00:00:00", b),
        lambda b: own.forget_content(batch(["sha256", "drive_uuid"]), b),
    ):
        before = seen.value
        assert update(f"b{before}") and not update(f"b{before}")
        assert seen.value == before + n
    assert own.read("files").count() == own.read("copies").count() == 20 - n
