"""What is on a drive against what the catalog says: rescans, verification, migration, undo, adoption."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.functions import origin, paths


def rescan_reconcile(recorded: DataFrame, on_disk: DataFrame, identified: DataFrame) -> DataFrame:
    """Recorded (path, sha256), on_disk (path), identified (path, sha256 of files looked into). Disjoint buckets:
    of the records placed, moved (a row for each place found) and unaccounted; of the other files claimed (where a moved
    record's content is), stray (any other that was looked into), debris (hidden) and unidentified."""
    disk = on_disk.select("path").distinct().withColumn("there", F.lit(True))
    both = recorded.join(disk, "path", "full_outer").join(identified.select("path", F.col("sha256").alias("seen")), "path", "left")
    where = identified.where("sha256 IS NOT NULL").select("sha256", F.col("path").alias("found")).distinct()
    gone = both.where("sha256 IS NOT NULL AND there IS NULL").select("path", "sha256").join(where, "sha256", "left")
    lost = gone.select("path", "sha256", F.when(F.col("found").isNotNull(), "moved").otherwise("unaccounted").alias("bucket"), "found")
    placed = both.where("sha256 IS NOT NULL AND there").select("path", "sha256", F.lit("placed").alias("bucket"), F.lit(None).cast("string").alias("found"))
    absent = gone.select(F.col("sha256").alias("seen")).distinct().withColumn("wanted", F.lit(True))
    extra = both.where("sha256 IS NULL").select("path", "seen").join(absent, "seen", "left")
    hidden = paths.basename(F.col("path")).startswith(".")
    bucket = F.when(F.col("wanted"), "claimed").when(F.col("seen").isNotNull(), "stray").when(hidden, "debris").otherwise("unidentified")
    return lost.unionByName(placed).unionByName(extra.select("path", F.col("seen").alias("sha256"), bucket.alias("bucket"), F.lit(None).cast("string").alias("found")))


def rescan_report(buckets: DataFrame, unreadable: DataFrame) -> DataFrame:
    """How many files each bucket has, a moved record once; complete if nothing was unreadable, and reconciled if
    besides nothing has moved, strayed or gone."""
    names = ("placed", "moved", "unaccounted", "claimed", "stray", "debris", "unidentified")
    once = buckets.groupBy("path", "bucket").agg(F.lit(1).alias("one"))
    counts = once.agg(*(F.count_if(F.col("bucket") == n).alias(n) for n in names))
    judged = counts.join(F.broadcast(unreadable.agg(F.count("*").alias("unreadable"))), F.lit(True))
    complete = F.col("unreadable") == 0
    return judged.withColumns({"complete": complete, "reconciled": complete & (F.col("moved") + F.col("stray") + F.col("unaccounted") == 0)})


def verify_copies(copies: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed (drive_uuid, relative, digest; null where it couldn't be read). By the first that holds: missing,
    unverifiable (no recorded digest), unreadable, mismatch, verified."""
    seen = observed.select("drive_uuid", "relative", "digest", F.lit(True).alias("there"))
    outcome = (
        F.when(F.col("there").isNull(), "missing").when(F.col("copy_sha256").isNull(), "unverifiable").when(F.col("digest").isNull(), "unreadable")
        .when(F.col("digest") != F.col("copy_sha256"), "mismatch").otherwise("verified")
    )
    return copies.join(seen, ["drive_uuid", "relative"], "left").select("sha256", "drive_uuid", outcome.alias("outcome"))


def copies_for_migration(files: DataFrame, copies: DataFrame, drive: str, events: DataFrame, trip_days: DataFrame, trips: DataFrame) -> DataFrame:
    """A drive's copies with their files, events (event_id, name, start) and trips by day."""
    own = copies.where(F.col("drive_uuid") == drive).select("sha256", "relative")
    joined = own.join(files.select("sha256", "original_name", "captured_at", "category", "event_id"), "sha256").withColumn("day", F.to_date("captured_at"))
    joined = joined.join(events.select("event_id", F.col("name").alias("event_name"), F.col("start").alias("event_start")), "event_id", "left")
    return joined.join(trip_days.select("day", "trip_id"), "day", "left").join(trips.select("trip_id", F.col("name").alias("trip_name"), F.col("start").alias("trip_start")), "trip_id", "left")


def plan_migration(rows: DataFrame, heavy: DataFrame, scheme: paths.Scheme = paths.DEFAULT_PRESET, *, composed: bool = False) -> DataFrame:
    """Rows of J5: the new place of each copy, and unchanged, collides (whatever the case), long and axis."""
    days = heavy.select("day").distinct().withColumn("is_heavy", F.lit(True))
    joined = rows.join(days, "day", "left")
    rule = F.when(F.col("category") == "Camera", "device").otherwise("fallback")
    event = F.when(F.col("event_id").isNotNull(), paths.event_folder(F.col("event_start"), paths.slugify(F.col("event_name")), F.col("event_name"), composed=composed))
    trip = F.when(F.col("trip_id").isNotNull(), paths.event_folder(F.col("trip_start"), paths.slugify(F.col("trip_name")), F.col("trip_name"), composed=composed))
    placement = paths.classify_placement(rule, trip, event, F.coalesce("is_heavy", F.lit(False)))
    folder = scheme.folder(placement, F.col("captured_at"), F.col("category"), event, trip, composed=composed)
    planned = joined.withColumn("new", F.concat_ws("/", folder, "original_name"))
    same = F.count("*").over(W.partitionBy(F.lower("new"))) > 1
    return planned.select(
        "sha256", "relative", "new", (F.col("relative") == F.col("new")).alias("unchanged"), same.alias("collides"),
        (F.char_length("new") > paths.LONG_PATH).alias("long"), paths.everyday_axis_changed(F.col("relative"), F.col("new")).alias("axis"),
    )


def preview_warnings(rendered: DataFrame) -> DataFrame:
    """Paths that collide whatever the case, or are too long."""
    n = F.count("*").over(W.partitionBy(F.lower("path")))
    return rendered.select("path", (n > 1).alias("collides"), (F.char_length("path") > paths.LONG_PATH).alias("long"))


def free_relative(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Wanted (key, path) -> free: a path that is taken, or that an earlier key asks for, gets the least free _1,
    _2, … before its suffix. Paths that others ask for as they are count as in use, so no two rows get the same.

    Of a path's rows the r-th that needs a number gets the r-th free one. A number in use that is the i-th of its stem
    has ``number - i`` free ones below it, so the r-th free number is r and the count of those with fewer than r."""
    have = taken.select("path").distinct()
    first = F.row_number().over(W.partitionBy("path").orderBy("key")) - 1
    ranked = wanted.join(have.withColumn("_taken", F.lit(True)), "path", "left").withColumn("_r", first + F.when(F.col("_taken"), 1).otherwise(0))
    named = r"^(.*?[^/])(\.[^./]*)?$"
    numbered = r"^(.*[^/])_([1-9]\d{0,8})(\.[^./]*)?$"
    all_paths = have.union(wanted.select("path")).distinct()
    used = all_paths.where(F.col("path").rlike(numbered)).select(F.concat(F.regexp_extract("path", numbered, 1), F.regexp_extract("path", numbered, 3)).alias("path"), F.regexp_extract("path", numbered, 2).cast("long").alias("n")).distinct()
    below = used.withColumn("free", F.col("n") - F.row_number().over(W.partitionBy("path").orderBy("n")))
    # numbers in use come before the rows of the rank that is one above the free ones below them
    events = below.select("path", F.col("free").alias("at"), F.lit(0).alias("row"), F.lit(None).cast(wanted.schema["key"].dataType).alias("key"))
    events = events.union(ranked.where("_r > 0").select("path", (F.col("_r") - 1).cast("long"), F.lit(1), "key"))
    passed = F.count_if(F.col("row") == 0).over(W.partitionBy("path").orderBy("at", "row", "key").rowsBetween(W.unboundedPreceding, 0))
    number = events.withColumn("number", F.col("at") + 1 + passed).where("row = 1")
    renamed = F.concat(F.regexp_extract("path", named, 1), F.lit("_"), F.col("number").cast("string"), F.regexp_extract("path", named, 2))
    return ranked.where("_r = 0").select("key", "path", F.col("path").alias("free")).union(number.select("key", "path", renamed.alias("free")))


def emptied_paths(runs: DataFrame, moves: DataFrame, in_place: DataFrame) -> DataFrame:
    """Folders that completed migrations, and moves within one root, have taken files from."""
    done = moves.join(runs.where("finished_at IS NOT NULL").select("run_id"), "run_id").select(F.col("old_relative").alias("path"))
    local = in_place.where("source_root = dest_root").select(F.col("old_relative").alias("path"))
    return done.unionByName(local).distinct()


def emptied_ancestors(moved: DataFrame) -> DataFrame:
    """all folders above moved paths, deepest first."""
    folders = moved.select(F.explode(paths.ancestors(F.col("path"))).alias("folder")).distinct()
    return folders.withColumn("depth", F.size(F.split("folder", "/")))


def cleanup_tiers(folders: DataFrame, listing: DataFrame) -> DataFrame:
    """K8: empty, junk_only or occupied, by what is anywhere below each folder."""
    hidden = F.coalesce(paths.basename(F.col("path")).startswith("."), F.lit(False))
    below = listing.select(F.explode(paths.ancestors(F.col("path"))).alias("folder"), hidden.alias("junk")).groupBy("folder").agg(F.bool_or(~F.col("junk")).alias("occupied"))
    tier = F.when(F.col("occupied").isNull(), "empty").when(F.col("occupied"), "occupied").otherwise("junk_only")
    return folders.join(below, "folder", "left").select("folder", tier.alias("tier"))


def undo_plan(moves: DataFrame, listing: DataFrame) -> DataFrame:
    """Moves (old, new, moved_at) the other way, newest first; what isn't there any more, or whose place is taken,
    is skipped."""
    there = listing.select("path").distinct()
    at = lambda c, mark: there.select(F.col("path").alias(c), F.lit(True).alias(mark))
    joined = moves.join(at("new", "here"), "new", "left").join(at("old", "occupied"), "old", "left")
    action = F.when(F.col("here").isNull(), "moved_away").when(F.col("occupied"), "origin_occupied").otherwise("move_back")
    return joined.select("old", "new", "moved_at", action.alias("action"))


def repoint_plan(recorded: DataFrame, listing: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Recorded source paths below the old root as below the new, and whether they are there."""
    planned = recorded.select("sha256", "source_path", paths.rebase(F.col("source_path"), old_root, new_root).alias("new")).where("new IS NOT NULL")
    return planned.join(listing.select(F.col("path").alias("new"), F.lit(True).alias("there")).distinct(), "new", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def multiset_digest(path: Column, digest: Column) -> Column:
    """An aggregate that is equal for equal multisets of (path, digest) in whatever order: how many there are, and the sums
    of two independent hashes of each."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), path, digest).cast("decimal(38,0)"))
    return F.struct(F.count("*").alias("n"), hashed(1).alias("a"), hashed(2).alias("b"))


def adoption_verdict(copies: DataFrame, listing: DataFrame, digests: DataFrame, *, sample: int = 40, least_share: float = 0.5, probes: int = 3) -> DataFrame:
    """Which recorded drive an unlabelled tree is. Of an even sample of each drive's copies, how many the listing
    (path, and refused if it couldn't be described) has; of an even few of these whether the digests (path, digest) are the
    recorded ones, which of a baked copy is its own. All must agree. ``exact`` says whether all of the tree's digests are
    the drive's, no more and no less: one aggregate of each side, whatever their order."""
    from lumibase.operators.timeline import in_stride, stride_sample

    recorded = copies.select("drive_uuid", "relative", F.coalesce("copy_sha256", "sha256").alias("recorded"))
    own = stride_sample(recorded, "drive_uuid", "relative", sample)
    no = F.col("refused") if "refused" in listing.columns else F.lit(False)
    there = listing.groupBy(F.col("path").alias("relative")).agg(F.min(F.coalesce(no, F.lit(False))).alias("no"))
    seen = own.join(there, "relative", "left").join(digests.select(F.col("path").alias("relative"), "digest"), "relative", "left")
    here = F.coalesce(~F.col("no"), F.lit(False))
    drive = W.partitionBy("drive_uuid")  # at most the sample's rows
    placed = seen.withColumn("here", here).withColumns({"_present": F.count_if("here").over(drive), "_i": F.row_number().over(drive.orderBy(F.desc("here"), "relative")) - 1})
    probe = F.col("here") & F.coalesce(in_stride("_i", "_present", probes), F.lit(False))
    judged = placed.withColumn("probe", probe).groupBy("drive_uuid").agg(
        F.count("*").alias("sampled"), F.count_if("here").alias("present"), F.count_if("no").alias("refused"),
        F.count_if("probe").alias("probed"), F.count_if(F.col("probe") & (F.col("digest") == F.col("recorded"))).alias("agreed"),
    )
    needed = least_share * F.col("sampled")
    few = F.col("present") < needed
    verdict = (
        F.when(few & (F.col("present") + F.col("refused") >= needed), "unreadable").when(few, "no_match")
        .when((F.col("agreed") > 0) & (F.col("agreed") == F.col("probed")), "proven").otherwise("content_differs")
    )
    judged = judged.withColumns({"verdict": verdict, "probed": F.when(few, F.lit(0)).otherwise(F.col("probed")), "agreed": F.when(few, F.lit(0)).otherwise(F.col("agreed"))})
    drives = recorded.groupBy("drive_uuid").agg(multiset_digest(F.col("relative"), F.col("recorded")).alias("all"))
    tree = digests.agg(multiset_digest(F.col("path"), F.col("digest")).alias("tree"))  # one row
    exact = drives.join(F.broadcast(tree), F.lit(True)).select("drive_uuid", F.col("all").eqNullSafe(F.col("tree")).alias("exact"))
    return judged.join(exact, "drive_uuid")


def attach_copies(on_drive: DataFrame, copies: DataFrame, hashes: DataFrame, drive: str) -> DataFrame:
    """Files of a drive (path, digest) that aren't recorded, by any digest of a content: linked (the first path of
    each content), already_attached, unmatched or unreadable; and recorded copies that are absent."""
    recorded = copies.where(F.col("drive_uuid") == drive)
    new = on_drive.join(recorded.select(F.col("relative").alias("path")), "path", "left_anti")
    known = hashes.groupBy("digest").agg(F.min("sha256").alias("sha256"))
    held = recorded.select("sha256", F.lit(True).alias("held")).distinct()
    joined = new.join(known, "digest", "left").join(held, "sha256", "left")
    first = F.row_number().over(W.partitionBy("sha256").orderBy("path"))
    outcome = (
        F.when(F.col("digest").isNull(), "unreadable").when(F.col("sha256").isNull(), "unmatched").when(F.col("held"), "already_attached")
        .when(F.col("n") == 1, "linked").otherwise("repeated")
    )
    linked = joined.withColumn("n", first).select("path", "sha256", outcome.alias("outcome"))
    absent = recorded.select(F.col("relative").alias("path"), "sha256").join(on_drive.select("path"), "path", "left_anti")
    return linked.unionByName(absent.withColumn("outcome", F.lit("absent")))


def original_candidates(files: DataFrame, listing: DataFrame, dates: DataFrame) -> DataFrame:
    """Files (path, captured_at) with a backup beside them whose own date (dates: path, value) differs."""
    there = listing.select("path").distinct()
    parents = there.select(paths.parent(F.col("path")).alias("folder")).distinct().withColumn("listed", F.lit(True))
    backup = there.select(F.regexp_replace("path", "_original$", "").alias("live"), F.col("path").alias("backup")).where("live <> backup")
    joined = files.withColumn("folder", paths.parent(F.col("path"))).join(parents, "folder", "left").join(backup, F.col("path") == F.col("live"), "left")
    joined = joined.join(dates.select(F.col("path").alias("backup"), "value"), "backup", "left")
    outcome = F.when(F.col("listed").isNull(), "unreachable").when(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("captured_at")), "offer").otherwise("none")
    return joined.select("path", outcome.alias("outcome"), F.when(outcome == "offer", F.col("value")).alias("offered"))


def rederive(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """The classifier again, on original names, for files whose label isn't certain. metadata: sha256, tags."""
    unsure = files.where(~origin.is_side_bin(F.col("category"))).select("sha256", "original_name", "category")
    joined = unsure.join(metadata, "sha256", "left")
    found = joined.withColumn("m", origin.classify(F.col("original_name"), F.col("tags")))
    return found.select("sha256", "category", F.col("m.label").alias("label"), F.col("m.rule").alias("rule"))


def tag_fingerprint(tags: Iterable[str]) -> str:
    """One name for a set of requested tags, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(tags))).encode()).hexdigest()


def cache_reuse(listing: DataFrame, cache: DataFrame, *, want_sha: bool = True, want_perceptual: bool = False, tags: Iterable[str] | None = None) -> DataFrame:
    """Whether what was kept of a file still answers: path, size and time are the same, and it has what is asked: the
    digest, a look that was computed, the tags (tags_fp is the fingerprint of those that were read, and a wider or other
    set has to be read again). What isn't reused is to be read."""
    asked = F.lit(True)
    if want_sha:
        asked = asked & F.col("cached").isNotNull()
    if want_perceptual:
        asked = asked & F.col("perceptual_computed")
    if tags is not None:
        asked = asked & (F.col("tags_fp") == tag_fingerprint(tags)) & F.col("tags").isNotNull()
    columns = ["perceptual_computed", "tags_fp", "tags"]
    known = cache.select("path", "size", "mtime", F.col("sha256").alias("cached"), *(c for c in columns if c in cache.columns), F.lit(True).alias("known"))
    joined = listing.join(known, ["path", "size", "mtime"], "left")
    fits = F.coalesce(F.col("known") & asked, F.lit(False))
    return joined.select(*listing.columns, fits.alias("reused"), F.when(fits, F.col("cached")).alias("sha256"))


def left_behind(listing: DataFrame, placed: DataFrame, top: int = 5) -> DataFrame:
    """Folders with the most files that no run has placed; the total is on each row."""
    loose = listing.join(placed.select("path"), "path", "left_anti").groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))
    ranked = loose.orderBy(F.desc("files"), "folder").limit(top)
    total = loose.agg(F.sum("files").alias("total"), F.count("*").alias("folders")).withColumn("k", F.lit(0))
    return ranked.withColumn("k", F.lit(0)).join(total, "k").drop("k")


def archive_set_gaps(listing: DataFrame, path: str = "path") -> DataFrame:
    """Parts of split archives by format and stem, and the numbers missing between the first and the last."""
    name = paths.basename(F.col(path))
    tar = r"(?i)\.(tar\.gz|tar\.bz2|tar\.xz|tar|tgz|tbz2|txz)$"
    bare = F.regexp_replace(F.regexp_replace(name, tar, ""), r"(?i)\.zip$", "")
    part = r"^(.+)-(\d{2,4})$"
    number = F.regexp_extract(bare, part, 2).try_cast("int")
    rows = listing.where(name.rlike(tar) | name.rlike(r"(?i)\.zip$")).select(
        F.when(name.rlike(tar), "tar").otherwise("zip").alias("format"), F.when(bare.rlike(part), F.regexp_extract(bare, part, 1)).otherwise(bare).alias("stem"), number.alias("number")
    )
    sets = rows.groupBy("format", "stem").agg(F.count("*").alias("parts"), F.collect_set("number").alias("numbers"), F.min("number").alias("a"), F.max("number").alias("b"))
    missing = F.when(F.col("a").isNotNull(), F.array_sort(F.array_except(F.sequence("a", "b"), "numbers"))).otherwise(F.array().cast("array<int>"))
    return sets.select("format", "stem", "parts", F.array_join(missing.cast("array<string>"), ",").alias("missing"))
