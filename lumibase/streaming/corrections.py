"""Late rows in a timeline that is clustered already.

A timeline is three tables: its rows with the stretch between boundaries that each lies in, the stretches, and the number of
rows of each day. A late row can move boundaries only among its nearest neighbours, so only these days are judged again,
with as many rows on both sides as the neighbourhood needs; the stretches that have a day among them are cut anew, and all
others stay. An event whose members have changed has another signature, so a name that it had is no longer its own; a
trip keeps its name by its days.

Items have library, key (unique within a library), sha256, captured_at, lat and lon. Undated rows and rows that the timeline
has already (library and key) are left out, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.operators import timeline
from lumibase.operators.stages import written
from lumibase.operators.timeline import Clustering

STRETCH = ("first_at", "first_sha")


def _same(a: DataFrame | str, b: str, names: tuple[str, ...]) -> Column:
    made = F.lit(True)
    for n in names:
        made = made & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return made


def _semi(rows: DataFrame, keys: DataFrame, names: tuple[str, ...], how: str = "left_semi") -> DataFrame:
    return rows.alias("r").join(keys.select(*names).distinct().alias("k"), _same("r", "k", names), how)


@dataclass(frozen=True)
class Timeline:
    """Rows (with day, ends, first_at, first_sha), stretches (library, first_at, first_sha, last_at, files, lat, lon,
    signature) and days (library, day, n)."""

    rows: DataFrame
    stretches: DataFrame
    days: DataFrame

    def events(self, by: Clustering = Clustering()) -> DataFrame:
        """W1 without the number of the stretch."""
        own = self.stretches.where(F.col("files") >= by.least_files)
        return own.select("library", "files", F.col("first_at").alias("start"), F.col("last_at").alias("end"), "lat", "lon", "signature")

    def trips(self, claimed: DataFrame, by: Clustering = Clustering()) -> DataFrame:
        """W2 with the names of the days that are claimed (library, day, name)."""
        return timeline.named_trips(timeline.trips_of_days(self.days, self.events(by)), claimed)


@dataclass(frozen=True)
class Correction:
    """The timeline with the late rows, the changes of events (library, signature, change: gone or new), and which rows
    were read again."""

    timeline: Timeline
    changes: DataFrame
    reread: DataFrame


def _cut(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their stretch, and the stretches, of rows in blocks with _ends."""
    placed = written(timeline.counted_segments(cut).withColumn("ends", F.col("_ends")).drop("_ends"), "segments")
    key = F.struct("captured_at", "sha256")
    stretches = placed.groupBy("library", "segment").agg(
        F.min(key).alias("first"), F.max("captured_at").alias("last_at"), F.count("*").alias("files"),
        F.avg(F.when(F.col("lon").isNotNull(), F.col("lat"))).alias("lat"), F.avg(F.when(F.col("lat").isNotNull(), F.col("lon"))).alias("lon"), timeline.signature().alias("signature"),
    ).select("library", "segment", F.col("first.captured_at").alias("first_at"), F.col("first.sha256").alias("first_sha"), "last_at", "files", "lat", "lon", "signature")
    stretches = written(stretches, "stretches")
    named = placed.alias("p").join(stretches.select("library", "segment", *STRETCH).alias("s"), _same("p", "s", ("library", "segment")))
    rows = named.select(*(F.col(f"p.{c}") for c in placed.columns if c not in ("segment", "_t", "_block", "_row")), *STRETCH)
    return rows, stretches.drop("segment")


def cluster(items: DataFrame, by: Clustering = Clustering()) -> Timeline:
    """The timeline of all items."""
    rows, stretches = _cut(timeline.boundaries(timeline.in_blocks(items.withColumn("day", F.to_date("captured_at"))), by))
    rows = written(rows, "rows")
    return Timeline(rows, stretches, rows.groupBy("library", "day").agg(F.count("*").alias("n")))


def touched_days(days: DataFrame, window: int) -> DataFrame:
    """The days (library, day, n, late) that have to be read, with changed: whether boundaries in them can move. Those are
    the days with late rows, and the ones with a row at most ``window + 1`` places off; as many more rows around them
    make their neighbourhoods whole."""
    order = W.partitionBy("library").orderBy("day")
    begin = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = days.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("n"))
    before = F.max(F.when(F.col("late"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("late"), F.col("begin"))).over(order.rowsBetween(1, W.unboundedFollowing))
    placed = placed.withColumns({"before": before, "after": after})
    within = lambda margin: F.col("late") | F.coalesce(F.col("begin") < F.col("before") + margin, F.lit(False)) | F.coalesce(F.col("end") > F.col("after") - margin, F.lit(False))
    return placed.where(within(2 * (window + 1) + 1)).select("library", "day", within(window + 1).alias("changed"))


def correct(state: Timeline, late: DataFrame, by: Clustering = Clustering()) -> Correction:
    """The timeline as if the late rows had been there from the beginning."""
    columns = [c for c in state.rows.columns if c not in ("day", "ends", *STRETCH)]
    dated = late.where("captured_at IS NOT NULL").select(*columns).withColumn("day", F.to_date("captured_at"))
    new = written(_semi(dated, state.rows, ("library", "key"), "left_anti"), "late")
    counted = new.groupBy("library", "day").agg(F.count("*").alias("n"))
    both = state.days.withColumn("late", F.lit(False)).unionByName(counted.withColumn("late", F.lit(True)))
    days = written(both.groupBy("library", "day").agg(F.sum("n").alias("n"), F.max("late").alias("late")), "days")
    read = written(touched_days(days, by.window), "touched")

    spread = state.stretches.withColumn("day", F.explode(F.sequence(F.to_date("first_at"), F.to_date("last_at"))))
    hit = written(_semi(spread, read, ("library", "day")).select("library", *STRETCH).distinct(), "hit")
    stretch = ("library", *STRETCH)
    again = _semi(state.rows, hit, stretch).drop(*STRETCH)
    placed = timeline.in_blocks(again.unionByName(new.withColumn("ends", F.lit(None).cast("int"))))
    judged = timeline.boundaries(placed, by).alias("j").join(read.where("changed").alias("d"), _same("j", "d", ("library", "day")), "left")
    # what lies off the changed days keeps its boundary, as its neighbours there aren't all among these rows
    ends = F.when(F.col("d.changed"), F.col("j._ends")).otherwise(F.col("j.ends"))
    rows, stretches = _cut(judged.select(*(F.col(f"j.{c}") for c in placed.columns if c != "ends"), ends.alias("_ends")))

    after = Timeline(
        written(_semi(state.rows, hit, stretch, "left_anti").unionByName(rows), "rows"),
        written(_semi(state.stretches, hit, stretch, "left_anti").unionByName(stretches), "stretches"),
        days.drop("late"),
    )
    least = F.col("files") >= by.least_files
    old = _semi(state.stretches, hit, stretch).where(least).select("library", "signature", F.lit(-1).alias("by"))
    summed = old.unionByName(stretches.where(least).select("library", "signature", F.lit(1).alias("by"))).groupBy("library", "signature").agg(F.sum("by").alias("by"))
    changes = summed.where("by <> 0").select("library", "signature", F.when(F.col("by") < 0, "gone").otherwise("new").alias("change"))
    return Correction(after, changes, again.select("library", "key"))
