"""Events, trips and days of a library's timeline.

Items have library, key, sha256, captured_at and, if known, lat and lon. Ties in time are in the order of sha256.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.functions import origin, paths
from lumibase.functions.measures import haversine_km
from lumibase.operators.stages import ordered_blocks, written


@dataclass(frozen=True)
class Clustering:
    """When a pause ends an event."""

    sensitivity: float = 4.0
    window: int = 10
    least_files: int = 8
    least_gap_s: int = 3600
    most_gap_s: int = 48 * 3600
    jump_km: float = 50.0


def numbered(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], out: str = "n") -> DataFrame:
    """Adds row_number() by keys in an order that begins with the bucket. Rows are numbered within a key's bucket, and
    what the key's earlier buckets hold is added, so a key that very many rows have is not one task."""
    placed = rows.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_bucket").alias("_b"), before.alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    return own.join(offsets, reduce(Column.__and__, same)).withColumn(out, F.col("_own") + F.col("_before")).select(*rows.columns, out)


def _tail(array: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(array), 1, n))


def _log_gaps(times: Column) -> Column:
    """The logarithms of the gaps between neighbouring times."""
    return F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, 1 << 20), lambda a, b: F.log1p(F.greatest(b - a, F.lit(0.0))))


ORDER = ("library", "captured_at", "sha256")


def in_blocks(items: DataFrame, blocks: int | None = None) -> DataFrame:
    """Dated items in the order of library, time and digest, cut into blocks by a range shuffle, with _block and _row (a
    number that rises by one within a block). Blocks have about equally many rows, also if all rows are of one library,
    day or moment; the number is Spark's for a shuffle if it isn't given. The table is written, so that the numbers
    stay what they are."""
    dated = items.where("captured_at IS NOT NULL").withColumn("_t", F.unix_micros(F.col("captured_at").cast("timestamp")) / 1e6)
    return ordered_blocks(dated, [F.col(ORDER[0]).asc_nulls_first(), *ORDER[1:]], "timeline", blocks)


def boundaries(rows: DataFrame, by: Clustering = Clustering()) -> DataFrame:
    """Adds _ends to rows in blocks: 1 where an event ends behind the row, else 0.

    A gap is a boundary if it is over the longest allowed, or at least the shortest and far above the median of its
    neighbours (log scale, itself left out), or if the place jumps.

    A block's rows need no more of the library's others than the times of the nearest rows on both sides; these come from
    a table with one row for each block of a library."""
    w = by.window
    key = ["library", "_block"]
    own = W.partitionBy(*key)
    block = own.orderBy("_row")
    blocks = W.partitionBy("library").orderBy("_block")
    ends = rows.select(*key, "_row", "_t", "lat", "lon").withColumns({"_n": F.col("_row") - F.min("_row").over(own) + 1, "_m": F.max("_row").over(own) - F.col("_row") + 1}).where((F.col("_n") <= w + 1) | (F.col("_m") <= w + 1))
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col(n) <= w + 1, F.struct(n, "_t")))), lambda x: x["_t"])
    table = ends.groupBy(*key).agg(listed("_n").alias("head"), F.reverse(listed("_m")).alias("tail"), F.min(F.when(F.col("_n") == 1, F.struct("lat", "lon"))).alias("place"))
    before = _tail(F.flatten(F.collect_list("tail").over(blocks.rowsBetween(-w - 1, -1))), w + 1)
    after = F.slice(F.flatten(F.collect_list("head").over(blocks.rowsBetween(1, w + 1))), 1, w + 1)
    halo = table.withColumns({"before": before, "after": after, "next_place": F.lead("place").over(blocks)})
    halo = halo.select(
        F.col("library").alias("_l"), F.col("_block").alias("_b"), F.get("after", F.lit(0)).alias("_next_t"), "next_place",
        _tail(_log_gaps(F.concat("before", F.slice("head", 1, 1))), w).alias("_before"), F.slice(_log_gaps(F.col("after")), 1, w).alias("_after"),
    )
    joined = rows.join(halo, F.col("library").eqNullSafe(F.col("_l")) & F.col("_block").eqNullSafe(F.col("_b")))
    gaps = joined.withColumns({"gap": F.coalesce(F.lead("_t").over(block), "_next_t") - F.col("_t"), "_place": F.coalesce(F.lead(F.struct("lat", "lon")).over(block), "next_place")})
    gaps = gaps.withColumn("log_gap", F.when(F.col("gap").isNotNull(), F.log1p(F.greatest(F.col("gap"), F.lit(0.0)))))  # none behind a library's last row
    gaps = gaps.withColumns({"_p": F.collect_list("log_gap").over(block.rowsBetween(-w, -1)), "_q": F.collect_list("log_gap").over(block.rowsBetween(1, w))})
    missing = lambda near: F.greatest(F.lit(w) - F.size(near), F.lit(0))
    gaps = gaps.withColumn("around", F.array_sort(F.concat(_tail(F.col("_before"), missing("_p")), "_p", "_q", F.slice("_after", F.lit(1), missing("_q")))))
    n = F.size("around")
    middle = (F.get("around", F.floor((n - 1) / 2).cast("int")) + F.get("around", F.floor(n / 2).cast("int"))) / 2
    unusual = (F.col("gap") >= by.least_gap_s) & (n > 0) & (F.col("log_gap") - middle > by.sensitivity)
    jump = haversine_km(F.col("lat"), F.col("lon"), F.col("_place.lat"), F.col("_place.lon")) > by.jump_km
    return gaps.select(*rows.columns, (F.coalesce((F.col("gap") > by.most_gap_s) | unusual, F.lit(False)) | F.coalesce(jump, F.lit(False))).cast("int").alias("_ends"))


def counted_segments(cut: DataFrame) -> DataFrame:
    """Adds segment to rows with _ends: how many boundaries of the library lie before the row. The rows are written with
    the count of their own block, in the order in which boundaries were found, as blocks are summed besides."""
    key = ["library", "_block"]
    block = W.partitionBy(*key).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    columns = cut.columns
    cut = written(cut.withColumn("_own", F.coalesce(F.sum("_ends").over(block), F.lit(0))), "cut")
    blocks = W.partitionBy("library").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*key).agg(F.sum("_ends").alias("_sum"))
    sums = sums.select(F.col("library").alias("_sl"), F.col("_block").alias("_sb"), F.coalesce(F.sum("_sum").over(blocks), F.lit(0)).alias("_offset"))
    placed = cut.join(sums, F.col("library").eqNullSafe(F.col("_sl")) & F.col("_block").eqNullSafe(F.col("_sb")))
    return placed.withColumn("segment", F.col("_own") + F.col("_offset")).select(*columns, "segment")


def segments(items: DataFrame, by: Clustering = Clustering(), blocks: int | None = None) -> DataFrame:
    """W1, first half: adds segment, the number of the stretch between boundaries, per library. Undated items are left
    out."""
    return counted_segments(boundaries(in_blocks(items, blocks), by)).select(*items.columns, "segment")


def cluster_events(items: DataFrame, by: Clustering = Clustering()) -> DataFrame:
    """Proposed events per library: segment, files, start, end, centroid (A22) and signature."""
    grouped = segments(items, by).groupBy("library", "segment").agg(
        F.count("*").alias("files"),
        F.min("captured_at").alias("start"),
        F.max("captured_at").alias("end"),
        F.avg(F.when(F.col("lon").isNotNull(), F.col("lat"))).alias("lat"),
        F.avg(F.when(F.col("lat").isNotNull(), F.col("lon"))).alias("lon"),
        signature().alias("signature"),
    )
    return grouped.where(F.col("files") >= by.least_files)


def signature():
    """An event's identity: the digest of its members' digests in order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n").cast("binary"), 256)


def detect_trips(items: DataFrame, events: DataFrame, *, most_days: int = 30, most_dead_days: int = 1) -> DataFrame:
    """Runs of days on which an event starts, bridging single quiet days, split at the year, of two days at least.
    A run over the span is declined. ``days`` counts all files of each active day."""
    counts = items.groupBy("library", F.to_date("captured_at").alias("day")).agg(F.count("*").alias("n"))
    return trips_of_days(counts, events, most_days=most_days, most_dead_days=most_dead_days)


def trips_of_days(counts: DataFrame, events: DataFrame, *, most_days: int = 30, most_dead_days: int = 1) -> DataFrame:
    """W2 by the number of files of each day (library, day, n)."""
    active = events.select("library", F.to_date("start").alias("day")).distinct()
    days = active.join(counts, ["library", "day"])
    order = W.partitionBy("library").orderBy("day")
    before = F.lag("day").over(order)
    new = before.isNull() | (F.datediff("day", before) - 1 > most_dead_days) | (F.year("day") != F.year(before))
    runs = days.withColumn("run", F.sum(new.cast("int")).over(order))
    trips = runs.groupBy("library", "run").agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("*").alias("active_days"), F.sum("n").alias("files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "n")))).alias("days"),
    ).where("active_days >= 2")
    span = F.datediff("end_date", "start_date") + 1
    return trips.withColumn("outcome", F.when(span > most_days, "declined_span").otherwise("proposed")).drop("run")


def capture_day_counts(items: DataFrame, claimed_days: DataFrame | None = None) -> DataFrame:
    """Files per day of those without an event, days of trips left out."""
    loose = items.where("event_id IS NULL AND captured_at IS NOT NULL").withColumn("day", F.to_date("captured_at"))
    if claimed_days is not None:
        loose = loose.join(claimed_days.select("day"), "day", "left_anti")
    return loose.groupBy("day").agg(F.count("*").alias("files"))


def heavy_days(counts: DataFrame, threshold: int = 40) -> DataFrame:
    """Days with more files than the threshold."""
    return counts.where(F.col("files") > threshold)


def unevented(files: DataFrame, trip_days: DataFrame) -> DataFrame:
    """Dated camera files without an event on days that no trip claims."""
    loose = files.where("category = 'Camera' AND captured_at IS NOT NULL AND event_id IS NULL").withColumn("day", F.to_date("captured_at"))
    return loose.join(trip_days.select("day"), "day", "left_anti")


def named_overlay(events: DataFrame, names: DataFrame, skipped: DataFrame) -> DataFrame:
    """Names by signature; skipped signatures are left out."""
    return events.join(skipped.select("signature"), "signature", "left_anti").join(names.select("signature", "name"), "signature", "left")


def named_trips(trips: DataFrame, claimed: DataFrame) -> DataFrame:
    """Each trip with the name of the trip that holds the first of its days that any holds (claimed: library, day,
    name)."""
    held = trips.select("library", "start_date", F.explode(F.map_keys("days")).alias("day")).join(claimed, ["library", "day"])
    return trips.join(held.groupBy("library", "start_date").agg(F.min_by("name", "day").alias("name")), ["library", "start_date"], "left")


def review_cards(trips: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """A card for each proposed trip, and for each event whose first day no trip claims; largest first. ``files`` is
    what the card holds, ``day_total`` all files of its first day, ``name`` what it is named already (J15)."""
    proposed = trips.where("outcome = 'proposed'")
    claimed = proposed.select("library", F.explode(F.map_keys("days")).alias("day")).distinct()
    free = events.withColumn("day", F.to_date("start")).join(claimed, ["library", "day"], "left_anti")
    none = F.lit(None).cast("string")
    name = lambda df: (F.col("name") if "name" in df.columns else none).alias("name")
    cards = proposed.select("library", F.lit("trip").alias("kind"), F.col("start_date").alias("first_day"), F.col("end_date").alias("last_day"), "files", none.alias("signature"), name(trips))
    cards = cards.unionByName(free.select("library", F.lit("event").alias("kind"), F.col("day").alias("first_day"), F.to_date("end").alias("last_day"), "files", "signature", name(events)))
    totals = items.groupBy("library", F.to_date("captured_at").alias("first_day")).agg(F.count("*").alias("day_total"))
    return cards.join(totals, ["library", "first_day"], "left").orderBy(F.desc("files"), "library", "first_day", "signature")


def merge_cards(cards: DataFrame, day_counts: DataFrame, most_days: int = 30) -> DataFrame:
    """Cards of one group (column merge) as one, with the full totals of their days; a merge across years or over
    the span has an error instead."""
    spans = cards.groupBy("library", "merge").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    days = cards.select("library", "merge", F.explode(F.sequence("first_day", "last_day")).alias("day")).distinct()
    totals = days.join(day_counts, ["library", "day"], "left").groupBy("library", "merge").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
    error = F.when(F.year("first_day") != F.year("last_day"), "crosses_year").when(F.datediff("last_day", "first_day") + 1 > most_days, "over_span")
    return spans.join(totals, ["library", "merge"]).withColumn("error", error)


def split_card(days: DataFrame, at: str) -> DataFrame:
    """The days (library, day, n) of a card as two, before and from a day on."""
    side = F.when(F.col("day") < F.lit(at).cast("date"), "first").otherwise("second")
    return days.groupBy("library", side.alias("side")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("files"))


def commit_trips(decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """Decisions (decision, day) against claimed days (day, trip_id): all free makes a trip, all of one trip
    refreshes it, anything else does nothing."""
    joined = decisions.join(claims, "day", "left")
    judged = joined.groupBy("decision").agg(F.count("*").alias("days"), F.count("trip_id").alias("claimed"), F.countDistinct("trip_id").alias("trips"), F.min("trip_id").alias("one"))
    action = F.when(F.col("claimed") == 0, "create").when((F.col("claimed") == F.col("days")) & (F.col("trips") == 1), "refresh").otherwise("nothing")
    return judged.select("decision", "days", action.alias("action"), F.when(action == "refresh", F.col("one")).alias("trip_id"))


def commit_events(decisions: DataFrame, events: DataFrame, skips: DataFrame) -> DataFrame:
    """Decisions (signature, name) on events (signature, name) and skips (signature): a known event keeps its name
    whatever was decided; else a name makes one; without one the cluster is skipped, once."""
    held = events.select("signature", F.col("name").alias("held"))
    judged = decisions.join(held, "signature", "left").join(skips.select("signature", F.lit(True).alias("skipped")).distinct(), "signature", "left")
    given = F.nullif(F.trim("name"), F.lit(""))
    action = F.when(F.col("held").isNotNull(), "link").when(given.isNotNull(), "create").when(F.col("skipped"), "nothing").otherwise("skip")
    return judged.select("signature", action.alias("action"), F.coalesce("held", given).alias("name"))


def disambiguate_folders(events: DataFrame) -> DataFrame:
    """Events that render to one folder (whatever its case) get `` (2)``, `` (3)`` behind it, by start and key."""
    rows = numbered(events.withColumn("_folder", F.lower("folder")), ["_folder"], F.to_date("start"), ["start", "key"], "n")
    return rows.withColumn("folder", F.when(F.col("n") > 1, F.concat("folder", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("folder"))).drop("n", "_folder")


def folder_suggestions(members: DataFrame, roots: DataFrame | None = None, *, levels: int = 3, majority: float = 0.7) -> DataFrame:
    """Members (cluster, path, year): the name that at least a majority of all members of a cluster carry at one
    level of their folders, of the deepest level that has one. Names are tidied; junk and common roots are no names."""
    folders = F.filter(F.transform(paths.ancestors(F.col("path")), lambda p: F.element_at(F.split(p, "/"), -1)), lambda p: p != "")
    # members of a folder have its names, so each name is tidied once for a cluster, level and year
    exploded = members.select("cluster", "year", F.posexplode(F.slice(folders, 1, levels + 1)).alias("level", "raw")).groupBy("cluster", "level", "raw", "year").agg(F.count("*").alias("_files"))
    name = paths.strip_year(paths.tidy_folder(F.col("raw")), F.col("year"))
    named = exploded.withColumn("name", name).where(~origin.is_junk_folder(F.col("raw")) & ~origin.is_junk_folder(F.col("name")) & paths.has_content(F.col("name")))
    if roots is not None:
        named = named.join(roots.select("name"), "name", "left_anti")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
    counted = named.groupBy("cluster", "level", "name").agg(F.sum("_files").alias("n")).join(sizes, "cluster").where(F.col("n") >= majority * F.col("members"))
    best = F.min_by("name", F.struct("level", -F.col("n"), "name"))
    return counted.groupBy("cluster").agg(best.alias("suggestion"))


def suggestion_roots(members: DataFrame, *, share: float = 0.8, least_cards: int = 3) -> DataFrame:
    """Folder names that most cards carry, and which so name none of them."""
    folders = F.transform(paths.ancestors(F.col("path")), lambda p: F.element_at(F.split(p, "/"), -1))
    names = members.select("cluster", F.explode(folders).alias("raw")).distinct().select("cluster", paths.tidy_folder(F.col("raw")).alias("name")).distinct()
    cards = members.select("cluster").distinct().agg(F.count("*").alias("cards"))
    counted = names.groupBy("name").agg(F.count("*").alias("n")).join(F.broadcast(cards), F.lit(True))  # one row
    return counted.where((F.col("cards") >= least_cards) & (F.col("n") >= share * F.col("cards"))).select("name", "n")


def stills_corroborate(videos: DataFrame, stills: DataFrame, minutes: int = 2) -> DataFrame:
    """Videos (library, key, local): whether a still of the library lies within the minutes; null without stills.
    A range join by bins of that width: each video looks into three."""
    width = minutes * 60
    binned = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / width)
    s = stills.select("library", F.col("captured_at").alias("still"), binned(F.col("captured_at")).alias("bin")).distinct()
    v = videos.withColumn("bin", F.explode(F.array(*(binned(F.col("local")) + n for n in (-1, 0, 1)))))
    gap = F.abs(F.unix_timestamp(F.col("still").cast("timestamp")) - F.unix_timestamp(F.col("local").cast("timestamp")))
    near = v.join(s, ["library", "bin"]).where(gap <= width).select("library", "key").distinct().withColumn("near", F.lit(True))
    some = stills.select("library").distinct().withColumn("some", F.lit(True))
    joined = videos.join(near, ["library", "key"], "left").join(some, "library", "left")
    return joined.select(*videos.columns, F.when(F.col("some"), F.coalesce("near", F.lit(False))).alias("corroborated"))


def _scanned(rows: DataFrame, group: str, order: str, label: str, blocks: int | None) -> DataFrame:
    """Rows in blocks by group and order; null groups are one group. Ties are in the order of the whole row."""
    ties = [F.hash(*rows.columns)]
    return ordered_blocks(rows, [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), *ties], label, blocks)


def _joined_blocks(placed: DataFrame, table: DataFrame, group: str) -> DataFrame:
    """Rows with the columns of a table that has one row for each block of a group."""
    own = table.withColumnRenamed(group, "_g").withColumnRenamed("_block", "_b")
    return placed.join(own, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).drop("_g", "_b")


def stride_sample(rows: DataFrame, group: str, order: str, n: int, blocks: int | None = None) -> DataFrame:
    """N evenly spaced rows of each group (all of a smaller one): the rows floor(j * size / n) for j from 0 to n - 1.
    Rows are numbered within blocks of a group, and a table with one row for each of these gives the rest, so a group of
    any size is many tasks."""
    placed = _scanned(rows, group, order, "stride", blocks)
    counts = placed.groupBy(group, "_block").agg(F.count("*").alias("_rows"), F.min("_row").alias("_least"))
    own = W.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = counts.select(group, "_block", "_least", before.alias("_before"), F.sum("_rows").over(own).alias("_total"))
    numbered = _joined_blocks(placed, table, group).withColumn("_i", F.col("_before") + F.col("_row") - F.col("_least"))
    return numbered.where(in_stride("_i", "_total", n)).select(*rows.columns)


def in_stride(i: str, total: str, n: int) -> Column:
    """Whether a place (from 0) is among n evenly spaced ones of so many, in whole numbers."""
    step = F.expr(f"({i} * {n} + {total} - 1) div greatest({total}, 1)")  # the first j with j * total / n >= i
    return (F.col(total) <= n) | (F.call_function("div", step * F.col(total), F.lit(n)) == F.col(i))


def suffix_max(rows: DataFrame, group: str, order: str, size: str, blocks: int | None = None) -> DataFrame:
    """The largest size at or after each position: the largest of the later blocks of a group comes from a table with
    one row for each block, and that of the block's later rows from a scan of the block."""
    placed = _scanned(rows, group, order, "suffix", blocks)
    largest = placed.groupBy(group, "_block").agg(F.max(size).alias("_max"))
    later = F.max("_max").over(W.partitionBy(group).orderBy("_block").rowsBetween(1, W.unboundedFollowing))
    both = _joined_blocks(placed, largest.select(group, "_block", later.alias("_later")), group)
    own = F.max(size).over(W.partitionBy(group, "_block").orderBy(F.desc("_row")).rowsBetween(W.unboundedPreceding, 0))
    return both.select(*rows.columns, F.greatest(own, "_later").alias("largest_left"))


def record_trips(days: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claimed days (trip_id, day) after an upsert, a day keeping its first trip, and the trips' spans derived
    from their days anew."""
    new = incoming.select("trip_id", "day").join(days.select("day"), "day", "left_anti").groupBy("day").agg(F.min("trip_id").alias("trip_id"))
    claimed = days.select("trip_id", "day").unionByName(new)
    return claimed, claimed.groupBy("trip_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("*").alias("days"))


def record_events(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names by signature; a later name replaces an earlier one."""
    joined = events.select("signature", F.col("name").alias("old")).join(incoming.select("signature", F.col("name").alias("new")), "signature", "full_outer")
    return joined.select("signature", F.coalesce("new", "old").alias("name"))


def apply_events(rows: DataFrame, members: DataFrame, *, composed: bool = False) -> DataFrame:
    """Rows (sha256, folder) whose content is in a named event (members: sha256, start, name) go to its folder."""
    joined = rows.join(members.select("sha256", "start", "name"), "sha256", "left")
    event = paths.event_folder(F.col("start"), paths.slugify(F.col("name")), F.col("name"), composed=composed)
    inside = F.concat_ws("/", F.date_format("start", "yyyy"), event)
    return joined.select("sha256", F.when(F.col("name").isNotNull(), inside).otherwise(F.col("folder")).alias("folder"))
