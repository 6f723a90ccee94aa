"""Pipelines of several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.functions import dates, origin, paths
from lumibase.operators import catalog, decisions, duplicates, sidecars, timeline
from lumibase.operators.stages import dealt, written


def _quality(value: Column, source: Column) -> list[Column]:
    return [
        F.count_if(source == "rejected_sentinel").alias("sentinel_rejected"), F.count_if(source == "rejected_future").alias("future_rejected"),
        F.count_if(dates.is_suspect_default(value, source)).alias("suspect"),
    ]


def date_quality(resolved: DataFrame) -> DataFrame:
    """One row: files whose only date was a sentinel or in the future, and those at a reset clock's default. ``r``
    is what ``with_capture_datetime`` gives."""
    return resolved.agg(F.count("*").alias("files"), *_quality(F.col("r.value"), F.col("r.source")))


def _kinds(name: Column) -> list[Column]:
    kind = origin.media_kind(name)
    return [F.count_if(kind == k).alias(n) for k, n in (("image", "photos"), ("video", "videos"), ("audio", "audio"))]


def organize_preview(planned: DataFrame, resolved: DataFrame, *, skip_undated: bool = False) -> DataFrame:
    """One row of all that a preview reports. ``planned`` is K2 with path, size and placement, ``resolved`` is
    K1. The rows are summed up by label, and the labels' few rows give the totals and the tally."""
    rows = planned.join(resolved.select("path", "sha256", "kind"), "path")
    bucket = F.when(F.col("sha256").isNull(), "unreadable").otherwise(F.col("kind"))
    rows = rows.withColumn("bucket", bucket)
    goes = F.col("bucket").isin("unique", "near")
    dated = F.col("captured_at").isNotNull()
    is_ = lambda name: F.col("bucket") == name
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("size"))), F.lit(0))
    counted = [
        F.count("*").alias("files"), *_kinds(F.col("name")),
        F.count_if(is_("unique")).alias("new_unique"), F.count_if(is_("near")).alias("near_dup"), F.count_if(is_("exact")).alias("exact_dup"), F.count_if(is_("unreadable")).alias("unreadable"),
        F.count_if(goes & ~dated).alias("undated"), F.count_if(goes & (dated if skip_undated else F.lit(True))).alias("will_organize"),
        total(is_("exact")).alias("reclaimable_bytes"), total(is_("near")).alias("near_bytes"), total(goes).alias("need_bytes"),
        F.count_if(goes & (F.col("source") == "rejected_sentinel")).alias("sentinel_rejected"), F.count_if(goes & (F.col("source") == "rejected_future")).alias("future_rejected"),
        F.count_if(goes & dates.is_suspect_default(F.col("captured_at"), F.col("source"))).alias("suspect_default"), F.count_if(goes & (F.col("source") == "inferred_local")).alias("shifted"),
        F.count_if(goes & F.col("needs_review")).alias("needs_review"), F.count_if(goes & (F.col("placement") == "day_bucket")).alias("on_heavy_days"),
    ]
    names = ["files", "photos", "videos", "audio", "new_unique", "near_dup", "exact_dup", "unreadable", "undated", "will_organize", "reclaimable_bytes", "near_bytes", "need_bytes", "sentinel_rejected", "future_rejected", "suspect_default", "shifted", "needs_review", "on_heavy_days"]
    when = F.when(goes, F.col("captured_at"))
    labels = rows.groupBy("label").agg(*counted, F.count_if(goes).alias("n"), F.min(when).alias("earliest"), F.max(when).alias("latest"))
    # labels come from a few rules and applications, so the tally is short
    tally = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "label"))))
    folders = F.array_join(F.transform(tally, lambda x: F.concat(x["label"], F.lit(":"), (-x["n"]).cast("string"))), ";").alias("folders")
    return labels.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), folders)


def preview(
    catalog_rows: DataFrame, batch: DataFrame, now: Column, *, taken: str | None = None, threshold: int = 5, skip_undated: bool = False, unevented: DataFrame | None = None, day_threshold: int = 40
) -> DataFrame:
    """K4: a batch (id, path, name, tags, size, sha256, perceptual) planned, resolved against the catalog and summed up.

    Timeline files of days that hold more than so many get a folder for the day (A17); ``unevented`` are the times
    (captured_at) of the catalog's files that count besides the batch's own. Dates and labels are found once, and the
    days counted from what is written of them."""
    dated = written(dated_rows(batch, now, taken=taken, keep=("path", "size")), "dated")
    own = dated.where(origin.is_timeline(F.col("rule"))).select("captured_at")
    times = own if unevented is None else own.unionByName(unevented.select("captured_at"))
    counts = times.where("captured_at IS NOT NULL").groupBy(F.to_date("captured_at").alias("heavy_day")).agg(F.count("*").alias("files"))
    heavy = timeline.heavy_days(counts, day_threshold).select("heavy_day")
    planned = placed(dated.join(heavy, F.to_date("captured_at") == F.col("heavy_day"), "left"), F.col("heavy_day").isNotNull())
    return organize_preview(planned, duplicates.resolve(catalog_rows, batch, threshold), skip_undated=skip_undated)


def trip_review(items: DataFrame, events: DataFrame, names: DataFrame, skipped: DataFrame, claimed: DataFrame) -> DataFrame:
    """K7: the cards to review, largest first, with the name that an event or trip has already, and the folder name that
    its members suggest. Items have path besides; events are W1 (several steps read them, so they
    should be a written table); names (signature, name), skipped (signature), claimed (library, day, name)."""
    trips = timeline.named_trips(timeline.detect_trips(items, events), claimed)
    card = F.concat_ws("/", F.col("library").cast("string"), "kind", F.col("first_day").cast("string"), F.coalesce("signature", F.lit("")))
    cards = timeline.review_cards(trips, timeline.named_overlay(events, names, skipped), items).withColumn("cluster", card)
    spans = cards.select("library", "cluster", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    days = items.select("library", F.to_date("captured_at").alias("day"), "path", F.year("captured_at").alias("year"))
    members = written(days.join(dealt(spans, "library", "day"), ["library", "day"]).select("cluster", "path", "year"), "members")
    hints = timeline.folder_suggestions(members, timeline.suggestion_roots(members))
    columns = ("library", "kind", "first_day", "last_day", "files", "day_total", "name", "suggestion")
    return cards.join(hints, "cluster", "left").select(*columns).orderBy(F.desc("files"), "library", "first_day")


def library_stats(files: DataFrame, copies: DataFrame, drives: DataFrame) -> DataFrame:
    """K6: the stats view as rows (section, key, value): totals (A1), drives (A3), years (A7), formats (A8), dates (A6),
    look-alikes (A9) and the samples' totals (T2)."""
    none = F.lit(None).cast("string")
    row = lambda section, key, value: (F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("long").alias("value"))
    totals = catalog.stats_summary(files, copies)
    counts = [c for c in totals.columns if c not in ("earliest", "latest")]
    span = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in counts))).alias("x")).select(*row("total", F.col("x.key"), F.col("x.value")))
    parts = [
        span,
        catalog.list_drives(drives, copies).select(*row("drive", F.col("label"), F.col("files"))),
        catalog.by_year(files).where("year IS NOT NULL").select(*row("year", F.col("year"), F.col("files"))),
        catalog.counts_by_format(files).groupBy("extension").agg(F.sum("files").alias("files")).select(*row("format", F.col("extension"), F.col("files"))),
        catalog.date_provenance(files).select(*row("dates", F.col("date_source"), F.col("files"))),
        catalog.near_dup_flagged(files).select(*row("look_alike", none, F.col("files"))),
        catalog.zero_drive(files, copies).agg(F.count("*").alias("n")).select(*row("on_no_drive", none, F.col("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def library_status(files: DataFrame, copies: DataFrame, drives: DataFrame, now: str) -> DataFrame:
    """One row: files and bytes by kind, places with copies, custody (A2, A5) and how fresh its checks are."""
    kinds = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *_kinds(F.col("original_name")))
    places = catalog.list_drives(drives, copies).where("files > 0").agg(F.count("*").alias("places"))
    single = catalog.content_totals(files, copies).select("single_copies")
    parts = [kinds, places, single, catalog.custody_floor(files, copies), catalog.custody_freshness(drives, copies, now)]
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)  # one row each


def analyze(batch: DataFrame, now: Column, *, taken: str | None = None) -> DataFrame:
    """K3: one row on a batch (name, tags, size, sha256): census, what duplicates cost to find, dates and exact
    duplicates; looks are not compared."""
    dated = dates.with_capture_datetime(batch, now, taken=taken, out="r")
    value, source = F.col("r.value"), F.col("r.source")
    facts = dated.agg(*_kinds(F.col("name")), F.count_if(value.isNull()).alias("undated"), F.min(value).alias("earliest"), F.max(value).alias("latest"), *_quality(value, source))
    exact = batch.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_files"))
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [duplicates.forecast(batch, F.col("name")), facts, exact])  # one row each


def dated_rows(media: DataFrame, now: Column, *, taken: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """K2, first half: per file its label, rule, capture date, source and tag, and further columns to keep."""
    dated = dates.with_capture_datetime(media, now, taken=taken, out="_r").withColumn("_m", origin.classify(F.col("name"), F.col("tags")))
    kept = [c for c in keep if c not in ("id", "name")]
    return dated.select("id", "name", *kept, F.col("_m.label").alias("label"), F.col("_m.rule").alias("rule"), F.col("_r.value").alias("captured_at"), F.col("_r.source").alias("source"), F.col("_r.tag").alias("tag"))


def placed(dated: DataFrame, heavy: Column | None = None) -> DataFrame:
    """K2, second half: adds placement, new_name, folder and needs_review."""
    at, nothing = F.col("captured_at"), F.lit(None).cast("string")
    place = paths.classify_placement(F.col("rule"), nothing, nothing, F.lit(False) if heavy is None else heavy)
    rows = dated.withColumns({"placement": place, "_label": paths.sanitize_value(F.col("label"))})  # sanitized once, for all layouts
    folder = paths.DEFAULT_PRESET.folder(F.col("placement"), at, F.col("_label"), nothing, nothing, composed=True)
    made = {"new_name": paths.dated_filename(F.col("name"), at, F.col("source") != "filename"), "folder": folder, "needs_review": origin.needs_review(F.col("source"))}
    return rows.withColumns(made).drop("_label", "rule")


def plan(media: DataFrame, now: Column, *, taken: str | None = None, heavy: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """K2: per file its label, capture date and source, placement, dated name and folder, and further columns to keep."""
    return placed(dated_rows(media, now, taken=taken, keep=keep), heavy)


def inferred_local_shifts(planned: DataFrame) -> DataFrame:
    """The files whose clock was shifted, with the evidence and the minutes."""
    # exploding keeps the condition above the ladder; as a filter it would be pushed down into each of its steps
    shift = F.when(F.col("source") == "inferred_local", F.array(dates.parse_date_tag(F.col("tag"))))
    return planned.select("id", F.explode(shift).alias("p")).select("id", "p.evidence", "p.minutes")


def ingest_preview(catalog_rows: DataFrame, batch: DataFrame, sidecar_files: DataFrame, now: Column) -> DataFrame:
    """K5: a batch (id, path, folder, name, tags, size, sha256, perceptual) matched to its sidecars (folder, name,
    taken_at), planned and resolved as K4 does, and reported per source of the date."""
    matched = sidecars.match_sidecars(batch.select("folder", "name"), sidecar_files.select("folder", "name")).withColumnRenamed("media", "name").distinct()
    told = sidecar_files.select("folder", F.col("name").alias("sidecar"), F.col("taken_at").alias("_taken"))
    rows = batch.join(matched, ["folder", "name"], "left").join(told, ["folder", "sidecar"], "left")
    planned = plan(rows, now, taken="_taken", keep=("path", "size", "sidecar")).withColumnRenamed("source", "date_source")
    resolved = duplicates.resolve(catalog_rows, batch, perceptual=False).select("path", "kind")
    return sidecars.ingest_report(planned.select("path", "size", "sidecar", "date_source").join(resolved, "path"))


def reconcile_decisions(section: DataFrame, settings: DataFrame, confirmations: DataFrame, catalog_events: DataFrame, current_settings: DataFrame, held: DataFrame, contents: DataFrame) -> DataFrame:
    """K9: the drives' documents merged (W4 events, W5 confirmations, W6 settings), and what each decision would do to
    the catalog (J28), counted by section and action."""
    events = decisions.restore_events(decisions.merge_section(section).select(F.col("key").alias("signature"), F.col("value").alias("name")), catalog_events)
    dated = decisions.restore_confirmations(decisions.merge_confirmations(confirmations), held, contents)
    set_ = decisions.restore_settings(decisions.merge_settings(settings).select("key", "value"), current_settings)
    parts = [df.select(F.lit(name).alias("section"), "action") for name, df in (("events", events), ("date_confirmations", dated), ("settings", set_))]
    return reduce(DataFrame.unionByName, parts).groupBy("section", "action").agg(F.count("*").alias("decisions"))
