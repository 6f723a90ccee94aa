"""The catalog's updates (S5, S6, S10 to S15) on tables of buckets: each reads and writes the buckets of its keys only.

``files``, ``copies`` and ``events`` are ``Snapshots`` with the keys below. A batch is named by the caller; run again, it
changes nothing, whether it failed before or after the switch. An update of two tables names its batch in both, the table
that the other one is derived from first, so that a retry goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumibase.operators import catalog, timeline
from lumibase.operators.stages import written
from lumibase.sources.snapshots import Snapshots

KEYS = {"files": ("sha256",), "copies": ("sha256",), "events": ("signature",), "trip_days": ("day",)}


class Catalog:
    """The tables below one path. Copies are bucketed by content, so that files and copies of a content share a number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.buckets = buckets
        self.tables = {name: Snapshots(spark, f"{path.rstrip('/')}/{name}") for name in KEYS}

    def create(self, batch: str = "", **rows: DataFrame) -> None:
        for name, df in rows.items():
            self.tables[name].create(df, KEYS[name], self.buckets, batch)

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _read_once(self, rows: DataFrame, table: str, batch: str) -> DataFrame:
        """What an update reads several times, written; but for a batch that the table has already."""
        now = self.tables[table].manifest()
        return rows if now is not None and batch and batch in now.batches else written(rows, f"{table}-batch")

    def upsert_files(self, incoming: DataFrame, confirmations: DataFrame, batch: str = "", order: str | None = None) -> bool:
        """S5. Confirmations of contents that the batch doesn't touch stay as they were recorded."""
        return self.tables["files"].update(incoming, lambda old: catalog.upsert_files(old, incoming, confirmations.join(incoming, "sha256", "left_semi"), order), batch)

    def upsert_copies(self, incoming: DataFrame, batch: str = "", order: str | None = None) -> bool:
        """S6."""
        incoming = self._read_once(incoming, "copies", batch)
        return self.tables["copies"].update(incoming, lambda old: catalog.upsert_copies(old, incoming, order), batch)

    def apply_verification(self, outcomes: DataFrame, now: str, batch: str = "") -> bool:
        """S10."""
        outcomes = self._read_once(outcomes, "copies", batch)
        return self.tables["copies"].update(outcomes, lambda old: catalog.apply_verification(old, outcomes, now), batch)

    def confirm_dates(self, confirmations: DataFrame, batch: str = "") -> bool:
        """The files, then their copies, which then lack the date."""
        first = self.tables["files"].update(confirmations, lambda old: catalog.upsert_files(old, old.limit(0), confirmations.join(old, "sha256", "left_semi")), batch)
        none = lambda old: catalog.confirm_dates(self.read("files").limit(0), old, confirmations)[1]
        return self.tables["copies"].update(confirmations, none, batch) or first

    def record_bakes(self, bakes: DataFrame, batch: str = "") -> bool:
        """S12."""
        return self.tables["copies"].update(bakes, lambda old: catalog.record_bakes(old, bakes), batch)

    def forget_content(self, forgotten: DataFrame, batch: str = "") -> bool:
        """The copies, then the files that lost their last one by it."""
        forgotten = self._read_once(forgotten, "files", batch)
        first = self.tables["copies"].update(forgotten, lambda old: old.join(forgotten, ["sha256", "drive_uuid"], "left_anti"), batch)
        copies = self.read("copies").join(forgotten, "sha256", "left_semi")
        touched = self._read_once(forgotten.select("sha256").distinct().join(copies, "sha256", "left_anti"), "files", batch)
        return self.tables["files"].update(touched, lambda old: old.join(touched, "sha256", "left_anti"), batch) or first

    def relocate(self, moves: DataFrame, table: str, column: str, batch: str = "") -> bool:
        """S14."""
        return self.tables[table].update(moves, lambda old: catalog.relocate(old, moves, column), batch)

    def record_events(self, incoming: DataFrame, batch: str = "") -> bool:
        """S15."""
        return self.tables["events"].update(incoming, lambda old: timeline.record_events(old, incoming), batch)

    def record_trips(self, incoming: DataFrame, batch: str = "") -> bool:
        """Days keep the trip that has claimed them first."""
        return self.tables["trip_days"].update(incoming, lambda old: timeline.record_trips(old, incoming)[0], batch)

    def trips(self) -> DataFrame:
        """The spans of the trips by their days."""
        return self.read("trip_days").groupBy("trip_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("*").alias("days"))
