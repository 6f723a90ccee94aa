"""Incremental forms of the batch operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumibase.functions import dates, origin
from lumibase.functions.measures import EARTH_KM
from lumibase.operators.timeline import Clustering
from lumibase.sources import METADATA_SCHEMA


def dedup_stream(items: DataFrame, horizon: str = "7 days") -> DataFrame:
    """R2: the first of each content within a horizon of event time."""
    return items.withWatermark("captured_at", horizon).dropDuplicatesWithinWatermark(["sha256"])


def session_events(items: DataFrame, gap: str = "48 hours", late: str = "1 hour", least_files: int = 8) -> DataFrame:
    """R3 by session windows: islands without a pause over the gap."""
    grouped = items.withWatermark("captured_at", late).groupBy("library", F.session_window("captured_at", gap)).agg(F.count("*").alias("files"), F.min("captured_at").alias("start"), F.max("captured_at").alias("end"))
    return grouped.where(F.col("files") >= least_files).select("library", "files", "start", "end")


class EventIslands(StatefulProcessor):
    """Keeps a library's rows until an island of them has been silent for the longest allowed gap, then gives out the
    island's events and drops its days. The sharper boundaries of the batch operator are found within the island.

    A batch appends its rows to a library's, as one packed element, and reads and writes only the first and last time of
    each day; which days make up an island follows from these, as a gap of two days never lies within one. Each island
    that is open has a timer, so an island closes though its library goes on. Few and small calls go to the state: a
    call costs more than the work on most libraries' rows."""

    def __init__(self, by: Clustering = Clustering()):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.spans = handle.getListState("spans", "day int, first bigint, last bigint")

    def islands(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, list[int]]]:
        """The last time and the days of each island, in order, of the first and last time of each day."""
        found: list[tuple[int, list[int]]] = []
        for day, first, last in sorted(spans):
            if found and first - found[-1][0] <= self.by.most_gap_s * 1_000_000:
                found[-1][1].append(day)
                found[-1] = (last, found[-1][1])
            else:
                found.append((last, [day]))
        return found

    def closing(self, last: int) -> int:
        """When an island that ends at this time is closed, in milliseconds."""
        return last // 1000 + self.by.most_gap_s * 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(s) for s in self.spans.get()]
        spans, arrived = {s[0]: s for s in before}, []
        for batch in rows:
            arrived.append((packed(batch),))
            at = np.sort(batch["at"].to_numpy())
            days, begins = np.unique(at // DAY, return_index=True)
            for day, first, last in zip(days.tolist(), at[begins].tolist(), at[np.append(begins[1:], len(at)) - 1].tolist(), strict=True):
                _, a, b = spans.get(day, (day, first, last))
                spans[day] = (day, min(a, first), max(b, last))
        self.rows.appendList(arrived)
        self.spans.put(list(spans.values()))
        # a timer is there for each island that was open, and for no other time
        there, wanted = ({self.closing(last) for last, _ in self.islands(s)} for s in (before, list(spans.values())))
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all islands that are due close at the first of their timers, and the others find nothing
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = [tuple(s) for s in self.spans.get()]
        due = [days for last, days in self.islands(spans) if self.closing(last) <= until]
        if not due:
            return
        held = pa.concat_tables([unpacked(r[0]) for r in self.rows.get()])
        day = held["at"].to_numpy() // DAY
        for days in due:
            out = closed_events(held.filter(pa.array(np.isin(day, days))), self.by)
            if len(out):
                out.insert(0, "library", key[0])
                yield out
        gone = {d for days in due for d in days}
        left = [s for s in spans if s[0] not in gone]
        if left:
            self.spans.put(left)
            self.rows.put([(stored(held.filter(pa.array(~np.isin(day, list(gone)))).combine_chunks()),)])
        else:
            self.spans.clear()
            self.rows.clear()

    def close(self) -> None:
        pass


DAY = 86_400_000_000
#: What is kept of a row.
PACKED = pa.schema([("at", pa.int64()), ("sha256", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])


def packed(rows: pd.DataFrame) -> bytes:
    return stored(pa.Table.from_arrays([pa.array(rows[f.name], f.type, from_pandas=True) for f in PACKED], schema=PACKED))


def stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(blob)).read_all()


def closed_events(items: pa.Table, by: Clustering) -> pd.DataFrame:
    """Events of one island's rows (at in microseconds, sha256, lat, lon): files, start, end, lat, lon and signature, by the
    boundaries of ``operators.timeline.boundaries``."""
    items = items.take(pc.sort_indices(items, [("at", "ascending"), ("sha256", "ascending")]))
    at, lat, lon = items["at"].to_numpy(), *(items[c].to_numpy() for c in ("lat", "lon"))  # a null place is not a number here
    gaps = np.diff(at) / 1e6
    logs = np.log1p(np.maximum(gaps, 0))
    a, b = np.radians(lat), np.radians(lon)
    half = np.sin((a[1:] - a[:-1]) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin((b[1:] - b[:-1]) / 2) ** 2
    far = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(half, 1))) > by.jump_km  # false where a place is unknown
    cut = (gaps > by.most_gap_s) | far
    for n in np.flatnonzero((gaps >= by.least_gap_s) & ~cut):  # the median is needed of long gaps only
        around = np.concatenate((logs[max(0, n - by.window) : n], logs[n + 1 : n + 1 + by.window]))
        cut[n] = len(around) > 0 and logs[n] - np.median(around) > by.sensitivity
    begins = np.concatenate(([0], np.flatnonzero(cut) + 1))
    ends = np.append(begins[1:], len(at))
    kept = ends - begins >= by.least_files
    known = ~(np.isnan(lat) | np.isnan(lon))
    places = np.add.reduceat(known, begins, dtype="int64")
    mean = lambda c: np.divide(np.add.reduceat(np.where(known, c, 0.0), begins), places, out=np.full(len(begins), np.nan), where=places > 0)[kept]
    shas = items["sha256"].combine_chunks()
    signed = [hashlib.sha256("\n".join(sorted(shas[x:y].to_pylist(), key=str.encode)).encode()).hexdigest() for x, y in zip(begins[kept].tolist(), ends[kept].tolist(), strict=True)]
    return pd.DataFrame({"files": (ends - begins)[kept], "start": at[begins[kept]], "end": at[ends[kept] - 1], "lat": mean(lat), "lon": mean(lon), "signature": pd.Series(signed, dtype=object)})


def event_stream(items: DataFrame, by: Clustering = Clustering(), late: str = "1 hour") -> DataFrame:
    """Events of closed islands, per library. Needs a state store that holds more than memory does (RocksDB)."""
    place = lambda c: (F.col(c) if c in items.columns else F.lit(None)).cast("double").alias(c)
    marked = items.withWatermark("captured_at", late)
    rows = marked.select(F.col("library").cast("bigint").alias("library"), "captured_at", F.unix_micros("captured_at").alias("at"), "sha256", place("lat"), place("lon"))
    found = rows.groupBy("library").transformWithStateInPandas(
        EventIslands(by), "library bigint, files bigint, start bigint, end bigint, lat double, lon double, signature string", "append", "eventTime"
    )
    return found.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end")})


def late_rows(batch: DataFrame, closed_until: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch in time, and those before the point up to which their library is closed (library, until),
    which the batch operator clusters again: their events get new signatures, so names given before don't apply."""
    joined = batch.join(closed_until, "library", "left")
    is_late = F.coalesce(F.col("captured_at") <= F.col("until"), F.lit(False))
    return joined.where(~is_late).drop("until"), joined.where(is_late).drop("until")


def ingest_batch(catalog_path: str):
    """A ``foreachBatch`` function that adds the contents of a batch which the catalog lacks, with label and rule,
    captured_at, date_source and date_tag. A batch that is run again writes the same folder again, so a retry changes
    nothing. Batches have sha256, name and tags; a batch without names or tags counts as one where all are null."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = None
        try:
            known = spark.read.option("basePath", catalog_path).parquet(f"{catalog_path}/batch=*").where(F.col("batch") != batch_id)
        except Exception as e:  # the first batch: no catalog yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        ingest_rows(batch, known, F.localtimestamp()).write.mode("overwrite").parquet(f"{catalog_path}/batch={batch_id}")

    return run


def ingest_rows(batch: DataFrame, known: DataFrame | None, now: Column) -> DataFrame:
    """R1 for one batch: the contents (sha256) that are not known, once each, with label, rule, captured_at, date_source
    and date_tag by their name and tags."""
    rows = batch.dropDuplicates(["sha256"])
    if known is not None:
        rows = rows.join(known.select("sha256"), "sha256", "left_anti")
    kinds = {"name": "string", "tags": METADATA_SCHEMA.removeprefix("path string, tags ")}
    missing = [c for c in kinds if c not in rows.columns]
    made = rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing}) if missing else rows
    made = made.withColumn("_origin", origin.classify(F.col("name"), F.col("tags")))
    made = dates.with_capture_datetime(made, now, out="_date")
    found = {"label": "_origin.label", "rule": "_origin.rule", "captured_at": "_date.value", "date_source": "_date.source", "date_tag": "_date.tag"}
    return made.withColumns({c: F.col(x) for c, x in found.items()}).drop("_origin", "_date", *missing)
