"""The catalog of files, copies and drives: custody, statistics, search and snapshot updates.

Tables (FIXTURES.md): files (sha256, size, captured_at, category, date_source, date_tag, perceptual, original_name,
source_path, event_id), copies (sha256, drive_uuid, relative, copy_sha256, size, last_verified, missing_at,
date_baked_at), drives (uuid, label). A copy is present while ``missing_at`` is null. Drives are few and are left to
the optimizer's size check; nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.functions import dates, measures, origin


def present(copies: DataFrame) -> DataFrame:
    return copies.where(F.col("missing_at").isNull())


def copy_counts(copies: DataFrame) -> DataFrame:
    """sha256, n_copies, n_present, n_verified."""
    return copies.groupBy("sha256").agg(
        F.count("*").alias("n_copies"),
        F.count_if(F.col("missing_at").isNull()).alias("n_present"),
        F.count_if(F.col("last_verified").isNotNull()).alias("n_verified"),
    )


def stats_summary(files: DataFrame, copies: DataFrame) -> DataFrame:
    """A1: one row of totals over the library. The timeline is what is dated and of a camera; all else is the side bin,
    and a file without a copy has never been verified."""
    held = files.join(copy_counts(copies), "sha256", "left")
    n = F.coalesce("n_copies", F.lit(0))
    dated, camera = F.col("captured_at").isNotNull(), F.col("category") == "Camera"
    return held.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(n >= 2).alias("on_two_drives"),
        F.count_if(n == 1).alias("on_one_drive"),
        F.count_if(n == 0).alias("on_no_drive"),
        F.count_if(F.coalesce("n_verified", F.lit(0)) == 0).alias("never_verified"),
        F.count_if(~dated).alias("undated"),
        F.count_if(dated & camera).alias("timeline"),
        F.count_if(~dated | ~camera).alias("side_bin"),
        F.min("captured_at").alias("earliest"),
        F.max("captured_at").alias("latest"),
    )


def custody_floor(files: DataFrame, copies: DataFrame) -> DataFrame:
    """A2: files without a present copy, with one, the fewest copies of any file, the fewest of any that has one, and
    how many have just so many."""
    counted = files.select("sha256").join(copy_counts(copies), "sha256", "left").select(F.coalesce("n_present", F.lit(0)).alias("n"))
    levels = counted.groupBy("n").agg(F.count("*").alias("files"))
    held = F.when(F.col("n") > 0, F.struct("n", "files"))
    return levels.agg(
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("files"))), F.lit(0)).alias("no_copy"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("files"))), F.lit(0)).alias("one_copy"),
        F.min("n").cast("long").alias("floor"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("files"))), F.lit(0)).alias("held"),
        F.min(held)["n"].cast("long").alias("held_floor"),
        F.min(held)["files"].alias("at_held_floor"),
    )


def list_drives(drives: DataFrame, copies: DataFrame) -> DataFrame:
    """A3 and A4: a row for each drive. ``verified`` is the oldest check, null unless every copy has one."""
    counted = copies.groupBy(F.col("drive_uuid").alias("uuid")).agg(
        F.count("*").alias("files"),
        F.count_if(F.col("missing_at").isNotNull()).alias("missing"),
        F.count_if(F.col("last_verified").isNotNull()).alias("confirmed"),
        F.sum("size").alias("bytes"),
        F.max("missing_at").alias("last_missing"),
        F.when(F.count("*") == F.count("last_verified"), F.min("last_verified")).alias("verified"),
    )
    zero = {"files": F.coalesce("files", F.lit(0)), "missing": F.coalesce("missing", F.lit(0)), "confirmed": F.coalesce("confirmed", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))}
    return drives.select("uuid", "label").join(counted, "uuid", "left").withColumns(zero)


def content_totals(files: DataFrame, copies: DataFrame) -> DataFrame:
    """A5: files, bytes, and how many have one present copy."""
    single = present(copies).groupBy("sha256").count().where("count = 1").agg(F.count("*").alias("single_copies"))
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return totals.withColumn("k", F.lit(0)).join(single.withColumn("k", F.lit(0)), "k").drop("k")


def date_provenance(files: DataFrame, most_evidence: int = 4) -> DataFrame:
    """A row for each date source with what it means (F28): label, detail, files, review, the first few different
    sentences of evidence in order, whether it was recorded at all, its share of the recorded files, and the totals."""
    by_tag = files.groupBy("date_source", "date_tag").agg(F.count("*").alias("n"))
    said = by_tag.withColumn("sentence", dates.explain_evidence(F.col("date_source"), F.col("date_tag")))
    by_sentence = said.groupBy("date_source", "sentence").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("date_source").orderBy(F.col("sentence").asc_nulls_last()))
    first = F.when(place <= most_evidence, F.col("sentence"))
    by_source = by_sentence.withColumn("first", first).groupBy("date_source").agg(F.sum("n").alias("files"), F.nullif(F.array_join(F.array_sort(F.collect_list("first")), ", "), F.lit("")).alias("evidence"))
    recorded = F.col("date_source").isNotNull()
    over = W.partitionBy()  # a row for each source
    total, known = F.sum("files").over(over), F.coalesce(F.sum(F.when(recorded, F.col("files"))).over(over), F.lit(0))
    rows = by_source.withColumns({"x": dates.explain_source(F.col("date_source")), "total": total, "recorded": known})
    share = F.when(recorded, F.round(F.col("files") / F.col("recorded"), 6))
    return rows.select("date_source", "x.label", "x.detail", "files", "x.review", "evidence", (~recorded).alias("not_recorded"), share.alias("share"), "total", "recorded")


def by_year(files: DataFrame) -> DataFrame:
    """Files per year of capture; null for undated."""
    return files.groupBy(F.year("captured_at").cast("long").alias("year")).agg(F.count("*").alias("files"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))


def counts_by_format(files: DataFrame, name: str = "original_name") -> DataFrame:
    """Files and bytes per kind and extension; kinds without files have no row."""
    kind = F.coalesce(origin.media_kind(F.col(name)), F.lit("other"))
    return files.groupBy(kind.alias("kind"), origin.extension(F.col(name)).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def near_dup_flagged(files: DataFrame) -> DataFrame:
    """Files whose look is shared by another."""
    groups = files.where("perceptual IS NOT NULL").groupBy("perceptual").count().where("count > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("files"))


def custody_freshness(drives: DataFrame, copies: DataFrame, now: str) -> DataFrame:
    """Drives never wholly checked and all their names, the oldest check of the others, its age and tier."""
    listed = list_drives(drives, copies).where("files > 0")
    days = measures.age_days(F.min("verified"), F.lit(now).cast("timestamp_ntz"))
    return listed.agg(
        F.count_if(F.col("verified").isNull()).alias("never_checked"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("verified").isNull(), F.col("label")))), ";").alias("never_checked_names"),
        F.min("verified").alias("oldest_check"),
        days.cast("long").alias("age_days"),
        measures.custody_tier(days).alias("tier"),
    )


def label_routes(files: DataFrame) -> DataFrame:
    """Files per label, and whether only a fixed rule can have given it."""
    return files.groupBy("category").agg(F.count("*").alias("files")).withColumn("route", F.when(origin.is_side_bin(F.col("category")), "side_bin").otherwise("ambiguous"))


def unfinished_runs(runs: DataFrame, copies: DataFrame) -> DataFrame:
    """Runs without an end whose drive holds fewer copies than they meant to write. runs: run_id, drive_uuid,
    intended, finished_at."""
    held = copies.groupBy("drive_uuid").agg(F.count("*").alias("held"))
    open_runs = runs.where("finished_at IS NULL").join(held, "drive_uuid", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return open_runs.where("held < intended").select("run_id", "drive_uuid", "intended", "held")


def runs_with_counts(runs: DataFrame, moves: DataFrame) -> DataFrame:
    """Runs with their number of moves."""
    counted = moves.groupBy("run_id").agg(F.count("*").alias("moves"), F.max("moved_at").alias("last_move"))
    return runs.join(counted, "run_id", "left").withColumn("moves", F.coalesce("moves", F.lit(0)))


# joins


def copies_on_drive(files: DataFrame, copies: DataFrame, drive: str, category: str | None = None) -> DataFrame:
    """Copies of one drive with their files, dated ones of a category."""
    own = copies.where(F.col("drive_uuid") == drive).select("sha256", "relative")
    wanted = files.where("captured_at IS NOT NULL")
    if category is not None:
        wanted = wanted.where(F.col("category") == category)
    return own.join(wanted, "sha256").select("sha256", "relative", "captured_at", "source_path")


def reclaim_candidates(files: DataFrame, copies: DataFrame, drive: str) -> DataFrame:
    """Files with a source that have a copy on the drive, and how many copies they have in all."""
    counts = copies.groupBy("sha256").agg(F.count("*").alias("copies"))
    own = copies.where(F.col("drive_uuid") == drive).select("sha256", "relative", "copy_sha256", "last_verified")
    return own.join(files.where("source_path IS NOT NULL").select("sha256", "source_path", "size"), "sha256").join(counts, "sha256")


def reclaim_plan(candidates: DataFrame, listing: DataFrame, observed: DataFrame, drive_root: str, min_copies: int = 1) -> DataFrame:
    """What may be freed, by the first reason against it. ``listing`` has the paths that exist, ``observed`` what
    the drive's copies hash to now (relative, digest). A copy without a recorded digest, or whose digest is another or
    can't be had, is unverified, whenever it was checked before."""
    there = listing.select(F.col("path").alias("source_path"), F.lit(True).alias("exists")).distinct()
    bucket = (
        F.when(F.col("exists").isNull(), "missing_source")
        .when(F.col("source_path") == F.concat(F.lit(drive_root), "relative"), "source_is_copy")
        .when(~F.coalesce(F.col("digest") == F.col("copy_sha256"), F.lit(False)), "unverified")
        .when(F.col("copies") < min_copies, "below_min_copies")
        .otherwise("candidate")
    )
    seen = observed.select("relative", "digest").dropDuplicates(["relative"])
    judged = candidates.join(there, "source_path", "left").join(seen, "relative", "left").withColumn("bucket", bucket)
    return judged.groupBy("bucket").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def find_copies(files: DataFrame, copies: DataFrame, drives: DataFrame, text: str) -> DataFrame:
    """Copies whose name, place or source contains the text, whatever its ASCII case; ``%`` and ``_`` are patterns."""
    pattern = f"%{text}%"
    joined = copies.join(files.select("sha256", "original_name", "source_path"), "sha256").join(drives.select(F.col("uuid").alias("drive_uuid"), "label"), "drive_uuid")
    hit = F.col("original_name").ilike(pattern) | F.col("relative").ilike(pattern) | F.coalesce(F.col("source_path").ilike(pattern), F.lit(False))
    return joined.where(hit).select("sha256", "original_name", "relative", "label")


def page(df: DataFrame, order: list[str], number: int, size: int = 50) -> DataFrame:
    """One page of a total order, with the exact total and the number of pages."""
    return with_total(df.orderBy(*order).offset(number * size).limit(size), df).withColumn("pages", F.ceil(F.col("total") / size))


def with_total(shown: DataFrame, df: DataFrame) -> DataFrame:
    """A few rows of a table with the exact number of all its rows."""
    total = df.agg(F.count("*").alias("total")).withColumn("_one", F.lit(0))
    return shown.withColumn("_one", F.lit(0)).join(F.broadcast(total), "_one").drop("_one")  # the total is one row


def single_copy(files: DataFrame, copies: DataFrame, drives: DataFrame) -> DataFrame:
    """Files with just one present copy, and where it is."""
    here = present(copies)
    once = here.groupBy("sha256").count().where("count = 1")
    held = here.select("sha256", "drive_uuid", "relative").join(once, "sha256", "left_semi").join(files.select("sha256", "original_name"), "sha256")
    return held.join(drives.select(F.col("uuid").alias("drive_uuid"), "label"), "drive_uuid").select("sha256", "original_name", "label", "relative")


def zero_drive(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Files without any copy."""
    return files.join(copies, "sha256", "left_anti")


def confirmations_to_bake(confirmations: DataFrame, copies: DataFrame, drive: str) -> DataFrame:
    """Copies of this drive whose confirmed date isn't written into the file yet."""
    waiting = copies.where((F.col("drive_uuid") == drive) & F.col("date_baked_at").isNull()).select("sha256", "relative")
    return confirmations.select("sha256", "captured_at").join(waiting, "sha256")


def drives_awaiting_bake(confirmations: DataFrame, copies: DataFrame, drives: DataFrame, drive: str) -> DataFrame:
    """The other drives that hold such copies, and how many."""
    waiting = copies.where((F.col("drive_uuid") != drive) & F.col("date_baked_at").isNull()).join(confirmations.select("sha256"), "sha256", "left_semi")
    counted = waiting.groupBy("drive_uuid").agg(F.count("*").alias("files"))
    return counted.join(drives.select(F.col("uuid").alias("drive_uuid"), "label"), "drive_uuid").select(F.col("drive_uuid").alias("uuid"), "label", "files")


def missing_on_target(copies: DataFrame, source: str, target: str) -> DataFrame:
    """Contents on one drive that another lacks."""
    on = lambda d: present(copies).where(F.col("drive_uuid") == d).select("sha256")
    return on(source).join(on(target), "sha256", "left_anti").distinct()


def matched_drives(matched: DataFrame, copies: DataFrame) -> DataFrame:
    """Per drive how many of the matched contents it holds, and under null how many are on none. A content on two
    drives counts for both."""
    held = matched.select("sha256").distinct().join(copies.select("sha256", "drive_uuid").distinct(), "sha256", "left")
    return held.groupBy("drive_uuid").agg(F.count("*").alias("files"))


def attachable_hashes(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Every digest by which a content can be known: its own, and those of its copies."""
    own = files.select("sha256", F.col("sha256").alias("digest"))
    return own.union(copies.where("copy_sha256 IS NOT NULL").select("sha256", "copy_sha256")).distinct()


def placed(hashes: DataFrame, copies: DataFrame) -> DataFrame:
    """Which of some hashes have a copy."""
    return hashes.select("sha256").intersect(copies.select("sha256"))


def unplaced(hashes: DataFrame, copies: DataFrame) -> DataFrame:
    return hashes.select("sha256").distinct().join(copies, "sha256", "left_anti")


def largest_files(files: DataFrame, n: int = 20) -> DataFrame:
    """The largest files, and how many have a size."""
    sized = files.where("size IS NOT NULL")
    return with_total(sized.orderBy(F.desc("size"), "source_path", "sha256").limit(n), sized)


def date_tier(files: DataFrame, source: str | None, n: int = 50) -> DataFrame:
    """The newest files of a date source and how many it has; None is a source of its own."""
    own = files.where(F.col("date_source").eqNullSafe(F.lit(source)))
    return with_total(own.orderBy(F.desc_nulls_last("captured_at"), "sha256").limit(n), own)


def undated_samples(files: DataFrame, n: int = 12) -> DataFrame:
    """Some undated files, and how many there are."""
    own = files.where("captured_at IS NULL").select("sha256", "original_name", "source_path")
    return with_total(own.orderBy("original_name", "sha256").limit(n), own)


def zero_drive_samples(files: DataFrame, copies: DataFrame, n: int = 12) -> DataFrame:
    """Some files on no drive, and how many there are."""
    own = zero_drive(files, copies).select("sha256", "original_name", "source_path")
    return with_total(own.orderBy("original_name", "sha256").limit(n), own)


# What other operators read of the catalog


def seed_rows(files: DataFrame) -> DataFrame:
    """What duplicates are looked up in."""
    return files.select("source_path", "sha256", "perceptual")


def known_sizes(files: DataFrame) -> DataFrame:
    """Sizes that some content has."""
    return files.where("size IS NOT NULL").select("size").distinct()


def organized_files(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Contents that have a copy, with their size."""
    return files.join(copies, "sha256", "left_semi").select("sha256", "size")


def copy_names(copies: DataFrame, drive: str) -> DataFrame:
    """The names under which a drive keeps its copies."""
    return copies.where(F.col("drive_uuid") == drive).select("sha256", F.element_at(F.split("relative", "/"), -1).alias("name"))


# snapshot updates: each returns the table as it is afterwards


def _last(incoming: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by a column, or else the greatest by all columns."""
    row = F.struct(*incoming.columns)
    one = F.max_by(row, F.struct(F.col(order), row)) if order else F.max(row)
    return incoming.groupBy(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys))).agg(one.alias("_row")).select("_row.*")


def upsert_files(files: DataFrame, incoming: DataFrame, confirmations: DataFrame, order: str | None = None) -> DataFrame:
    """Rows by sha256. A new row replaces the old one in every column that it has, also by null: a date that is no
    longer found takes its source and tag along. A person's confirmed date goes above all. Of several new rows of a
    content the last by ``order`` counts."""
    new = _last(incoming, ["sha256"], order)
    taken = lambda c: F.when(F.col("n.sha256").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in incoming.columns else F.col(f"o.{c}")
    merged = files.alias("o").join(new.alias("n"), F.col("o.sha256") == F.col("n.sha256"), "full_outer").select(*(taken(c).alias(c) for c in files.columns))
    confirmed = confirmations.groupBy("sha256").agg(F.max("captured_at").alias("_confirmed"), F.lit(True).alias("_sure"))
    joined = merged.join(confirmed, "sha256", "left")
    sure = F.col("_sure").isNotNull()
    return joined.withColumns({
        "captured_at": F.when(sure, F.col("_confirmed")).otherwise(F.col("captured_at")),
        "date_source": F.when(sure, "human_confirmed").otherwise(F.col("date_source")),
        "date_tag": F.when(~sure, F.col("date_tag")),
    }).select(*files.columns)


#: What writing a copy records; its checks and bakes are others' to set.
COPY_FACTS = ("relative", "copy_sha256", "size", "copied_at")


def upsert_copies(copies: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Rows by content and drive. A copy that is written again has the new place, size and digest, also where that
    is null and the copy so unverifiable; it is no longer missing. When it was last verified and baked stays."""
    new = _last(incoming.select(*(c for c in incoming.columns if c in ("sha256", "drive_uuid", *COPY_FACTS) or c == order)), ["sha256", "drive_uuid"], order)
    on = (F.col("o.sha256") == F.col("n.sha256")) & (F.col("o.drive_uuid") == F.col("n.drive_uuid"))
    joined = copies.alias("o").join(new.alias("n"), on, "full_outer")
    again = F.col("n.sha256").isNotNull()

    def after(c: str) -> Column:
        if c in ("sha256", "drive_uuid"):
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c == "missing_at":
            return F.when(~again, F.col("o.missing_at"))
        return F.when(again, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in COPY_FACTS and c in new.columns else F.col(f"o.{c}")

    return joined.select(*(after(c).alias(c) for c in copies.columns))


def apply_verification(copies: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Outcomes (sha256, drive_uuid, outcome). A verified copy is checked and present; a missing one is neither."""
    at = F.lit(now).cast("timestamp_ntz")
    joined = copies.join(outcomes, ["sha256", "drive_uuid"], "left")
    ok, gone = F.col("outcome") == "verified", F.col("outcome") == "missing"
    return joined.withColumns({
        "last_verified": F.when(ok, at).when(gone, F.lit(None)).otherwise(F.col("last_verified")),
        "missing_at": F.when(ok, F.lit(None)).when(gone, at).otherwise(F.col("missing_at")),
    }).select(*copies.columns)


def confirm_dates(files: DataFrame, copies: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with the confirmed dates, and copies of which none has that date in it yet."""
    unbaked = copies.join(confirmations.select("sha256", F.lit(True).alias("_again")), "sha256", "left")
    unbaked = unbaked.withColumn("date_baked_at", F.when(F.col("_again").isNull(), F.col("date_baked_at"))).select(*copies.columns)
    return upsert_files(files, files.limit(0), confirmations), unbaked


def record_bakes(copies: DataFrame, bakes: DataFrame) -> DataFrame:
    """Bakes (sha256, drive_uuid, copy_sha256, date_baked_at): the copy's digest changes with the time."""
    joined = copies.alias("o").join(bakes.alias("n"), ["sha256", "drive_uuid"], "left")
    done = F.col("n.date_baked_at").isNotNull()
    changed = {c: F.when(done, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("copy_sha256", "date_baked_at")}
    return joined.select(*(changed.get(c, F.col(c) if c in ("sha256", "drive_uuid") else F.col(f"o.{c}")) for c in copies.columns))


def forget_content(files: DataFrame, copies: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the forgotten copies (sha256, drive_uuid), and without files that lose their last copy by it."""
    left = copies.join(forgotten, ["sha256", "drive_uuid"], "left_anti")
    touched = forgotten.select("sha256").distinct().join(left, "sha256", "left_anti")
    return files.join(touched, "sha256", "left_anti"), left


def relocate(table: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """A new place (moves: sha256, new) for the rows that have one."""
    joined = table.join(moves.select("sha256", "new"), "sha256", "left")
    return joined.withColumn(column, F.coalesce("new", column)).select(*table.columns)
