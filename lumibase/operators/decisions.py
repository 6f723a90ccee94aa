"""Decisions that people made on several drives, merged: names, skips, confirmed dates and settings.

A section is a table (drive_uuid, written, key, value): one row for each thing that a drive's document says. ``written``
is the document's time, null for a document without one, which counts as the oldest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

# Setting prefixes that belong to one machine and aren't written to a document.
MACHINE_LOCAL = ("path_hint.", "decisions.", "catalog.")


def _ranked(keys: str) -> WindowSpec:
    """Newest document first, those without a time last, ties to the smaller drive; within a document by value."""
    return W.partitionBy(keys).orderBy(F.col("written").desc_nulls_last(), "drive_uuid", "value")


def merge_section(rows: DataFrame) -> DataFrame:
    """The newest document wins each key (ties to the smaller drive, documents without a time last); how many others
    said something different."""
    ranked = _with_winner(rows)
    return ranked.groupBy("key").agg(
        F.max_by("value", -F.col("rank")).alias("value"),
        F.min_by("drive_uuid", "rank").alias("drive_uuid"),
        F.count_if("lost").alias("overruled"),
    )


def _with_winner(rows: DataFrame) -> DataFrame:
    order = _ranked("key")
    won = F.first("value").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"rank": F.row_number().over(order), "lost": ~F.col("value").eqNullSafe(won)})


def superseded(rows: DataFrame) -> DataFrame:
    """How many decisions of each document another document overrules with something different."""
    return _with_winner(rows).where("lost").groupBy("drive_uuid").agg(F.count("*").alias("overruled"))


def merge_confirmations(rows: DataFrame) -> DataFrame:
    """Confirmations (drive_uuid, written, sha256, captured_at, confirmed_at): the newest row wins, ties by document
    as in W4: the newest, then that of the smaller drive."""
    order = W.partitionBy("sha256").orderBy(F.col("confirmed_at").desc_nulls_last(), F.col("written").desc_nulls_last(), "drive_uuid", "captured_at")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("sha256", "captured_at", "confirmed_at")


def superseded_confirmations(rows: DataFrame) -> DataFrame:
    """How many confirmed dates of each document are overruled. Documents are read from the newest on; a row that is
    later confirmed than the best so far takes its place, and the other one of the two is overruled if they differ."""
    order = W.partitionBy("sha256").orderBy(F.col("written").desc_nulls_last(), "drive_uuid", "captured_at", "confirmed_at")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    row = F.struct(F.col("confirmed_at"), (-F.col("rank")).alias("rank"), "captured_at", "drive_uuid")
    best = ranked.withColumn("best", F.max(row).over(order.rowsBetween(W.unboundedPreceding, -1))).where("best IS NOT NULL")
    later = F.coalesce(F.col("confirmed_at") > F.col("best.confirmed_at"), F.col("confirmed_at").isNotNull())
    differs = ~(F.col("confirmed_at").eqNullSafe(F.col("best.confirmed_at")) & F.col("captured_at").eqNullSafe(F.col("best.captured_at")))
    loser = F.when(later, F.col("best.drive_uuid")).otherwise(F.col("drive_uuid"))
    return best.where(differs).groupBy(loser.alias("drive_uuid")).agg(F.count("*").alias("overruled"))


def undated_documents(rows: DataFrame) -> DataFrame:
    """Documents without a time: they supply what no other says, and never overrule."""
    return rows.groupBy("drive_uuid").agg(F.count("written").alias("n")).where("n = 0").select("drive_uuid")


def is_machine_local(key):
    """Whether a setting belongs to one machine."""
    return F.coalesce(key.rlike("^(" + "|".join(p.replace(".", r"\.") for p in MACHINE_LOCAL) + ")"), F.lit(False))


def merge_settings(rows: DataFrame) -> DataFrame:
    """The last writer of each setting that isn't of one machine; whether its document has a time."""
    shared = rows.where(~is_machine_local(F.col("key")))
    rank = F.row_number().over(_ranked("key"))
    return shared.withColumn("rank", rank).where("rank = 1").select("key", "value", F.col("written").isNull().alias("undated"))


def merge_skips(rows: DataFrame) -> DataFrame:
    """All skipped signatures."""
    return rows.select(F.col("key").alias("signature")).distinct()


def restore_apply(merged: DataFrame, current: DataFrame, known: DataFrame) -> DataFrame:
    """Merged decisions (key, value, written) against the catalog's (key, value, updated) and the contents it knows
    (key): unchanged, newer_locally, awaiting_content or applied."""
    theirs = merged.select("key", F.col("value").alias("theirs"), "written")
    joined = theirs.join(current.select("key", F.col("value").alias("ours"), "updated"), "key", "left").join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    action = (
        F.when(F.col("known").isNull(), "awaiting_content").when(F.col("ours").eqNullSafe(F.col("theirs")), "unchanged")
        .when(F.coalesce(F.col("updated") > F.col("written"), F.lit(False)), "newer_locally").otherwise("applied")
    )
    return joined.select("key", "theirs", "ours", action.alias("action"))


def restore_trips(days: DataFrame, claimed: DataFrame) -> DataFrame:
    """Trips of the merged documents (trip, name, day; a trip without days has one null day) against claimed days
    (day, name): dayless, unchanged if all its days have its name already, conflicting if any is another's, else applied."""
    held = claimed.select("day", F.col("name").alias("holder"))
    judged = days.join(held, "day", "left").groupBy("trip").agg(
        F.first("name").alias("name"), F.count("day").alias("days"), F.count("holder").alias("held"), F.count_if(F.col("holder") == F.col("name")).alias("own")
    )
    action = (
        F.when(F.col("days") == 0, "dayless").when(F.col("own") == F.col("days"), "unchanged").when(F.col("held") > 0, "conflicting").otherwise("applied")
    )
    return judged.select("trip", "name", action.alias("action"))


def restore_events(events: DataFrame, current: DataFrame) -> DataFrame:
    """Events (signature, name): unmatched where the catalog has no such members, unchanged or applied."""
    joined = events.join(current.select("signature", F.col("name").alias("ours")), "signature", "left")
    action = F.when(F.col("ours").isNull(), "unmatched").when(F.col("ours") == F.col("name"), "unchanged").otherwise("applied")
    return joined.select("signature", "name", action.alias("action"))


def restore_confirmations(confirmations: DataFrame, held: DataFrame, contents: DataFrame) -> DataFrame:
    """Confirmed dates (sha256, captured_at, confirmed_at) against those held: an older or equally old one changes
    nothing (newer_locally where the dates differ); one for a content that is unknown awaits it."""
    ours = held.select("sha256", F.col("captured_at").alias("our_date"), F.col("confirmed_at").alias("our_time"))
    joined = confirmations.join(ours, "sha256", "left").join(contents.select("sha256", F.lit(True).alias("known")).distinct(), "sha256", "left")
    older = F.col("our_time") >= F.col("confirmed_at")
    action = (
        F.when(older & (F.col("our_date") != F.col("captured_at")), "newer_locally").when(older, "unchanged")
        .when(F.col("our_time").isNull() & F.col("known").isNull(), "awaiting_content").otherwise("applied")
    )
    return joined.select("sha256", action.alias("action"))


def restore_settings(settings: DataFrame, current: DataFrame) -> DataFrame:
    """Settings (key, value) that aren't as they are here are applied."""
    joined = settings.join(current.select("key", F.col("value").alias("ours")), "key", "left")
    return joined.select("key", F.when(F.col("ours").eqNullSafe(F.col("value")), "unchanged").otherwise("applied").alias("action"))


def would_lose(on_drive: DataFrame, document: DataFrame) -> DataFrame:
    """Sections in which a drive holds keys that the new document lacks. Both have section and key."""
    return on_drive.select("section", "key").distinct().exceptAll(document.select("section", "key").distinct()).groupBy("section").agg(F.count("*").alias("keys"))


def decision_notice(on_drive: DataFrame, document: DataFrame) -> DataFrame:
    """Sections that wait to be restored from the drive, or that are stale on it."""
    waiting = would_lose(on_drive, document).select("section", F.col("keys").alias("to_restore"))
    stale = would_lose(document, on_drive).select("section", F.col("keys").alias("stale"))
    both = waiting.join(stale, "section", "full_outer")
    return both.select("section", F.coalesce("to_restore", F.lit(0)).alias("to_restore"), F.coalesce("stale", F.lit(0)).alias("stale"))
