"""Tables of files that are updated bucket by bucket, each version seen whole or not at all.

A table is a folder. Rows go to buckets by a hash of their key; a bucket is a folder of Parquet files, and a manifest names
the folder of each bucket. An update reads the buckets that its keys touch and no others, writes these anew beside the old
ones, and then switches: the next manifest is created, which fails if another writer was faster. What comes before the
switch is seen by no reader, so a failed update needs no repair. The manifest lists the batches that it holds, so a batch
that is tried again after its switch changes nothing; one that failed before it writes new folders and switches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has switched first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: str
    #: The folder of each bucket that has rows, below the table's.
    folders: dict[str, str] = field(default_factory=dict)
    batches: tuple[str, ...] = ()


class Snapshots:
    """A table of buckets at a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{self.path}/{name}")
        self._files = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._files.exists(self._at("manifests")):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in self._files.listStatus(self._at("manifests")))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or that of a version; None before the first."""
        found = self._versions()
        if not found:
            return None
        stream = self._files.open(self._at(f"manifests/{found[-1] if version is None else version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        made = json.loads(text)
        return Manifest(**(made | {"keys": tuple(made["keys"]), "batches": tuple(made["batches"])}))

    def _switch(self, new: Manifest) -> None:
        """Makes a manifest the newest: its file is written whole under another name, which then must be free."""
        made, ready = self._at(f"manifests/{new.version}.json"), self._at(f"unfinished/{uuid.uuid4().hex}")
        self._files.mkdirs(self._at("manifests"))
        out = self._files.create(ready, False)
        out.write(bytearray(json.dumps(vars(new)).encode()))
        out.close()
        if self._files.exists(made) or not self._files.rename(ready, made):
            self._files.delete(ready, False)
            raise Conflict(f"version {new.version} of {self.path} is there already")

    def bucket(self, keys: tuple[str, ...], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, manifest: Manifest) -> dict[str, str]:
        """Writes rows into new folders, a bucket each; the folder of each bucket that has rows. Each task writes a file to
        each bucket that it has rows of: a shuffle by bucket would move all rows once more, for as many tasks as buckets."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", self.bucket(manifest.keys, manifest.buckets))
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        if not self._files.exists(self._at(name)):
            return {}
        found = [f.getPath().getName() for f in self._files.listStatus(self._at(name))]
        return {f.removeprefix("_bucket="): f"{name}/{f}" for f in found if f.startswith("_bucket=")}

    def create(self, rows: DataFrame, keys: tuple[str, ...], buckets: int = 64, batch: str = "") -> None:
        """The first version. A table that is there already is a conflict, but for one made by the same batch."""
        now = self.manifest()
        if now is not None:
            if batch and batch in now.batches:
                return
            raise Conflict(f"{self.path} is there already")
        first = Manifest(0, tuple(keys), buckets, rows.schema.json(), batches=(batch,) if batch else ())
        self._switch(replace(first, folders=self._written(rows, first)))

    def _of(self, manifest: Manifest, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        paths = [f"{self.path}/{manifest.folders[n]}" for n in names if n in manifest.folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an earlier one whose folders are still there."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(self.path)
        return self._of(manifest, list(manifest.folders))

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: str = "") -> bool:
        """Replaces the rows of the buckets that ``keys`` (a table with the key columns) touch by ``change`` of them, and
        says whether anything was done. ``change`` must leave each row in its bucket: rows of a key that is not among
        ``keys`` stay as they are.

        At most as many numbers as there are buckets go to the driver."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(self.path)
        if batch and batch in now.batches:
            return False
        touched = sorted(str(r[0]) for r in keys.select(self.bucket(now.keys, now.buckets).alias("b")).distinct().collect())
        new = self._written(change(self._of(now, touched)), now) if touched else {}
        lost = set(new) - set(touched)
        if lost:
            raise ValueError(f"rows of buckets that the keys don't touch: {sorted(lost)}")
        folders = {n: f for n, f in now.folders.items() if n not in touched} | new
        self._switch(replace(now, version=now.version + 1, folders=folders, batches=(*now.batches, batch) if batch else now.batches))
        return True

    def vacuum(self, versions: int = 2) -> int:
        """Removes older manifests and the folders that none of the newest names; how many buckets went. Readers of older
        versions and writers at work must have ended."""
        found = self._versions()
        used = {f for v in found[-versions:] for f in self.manifest(v).folders.values()}
        for v in found[:-versions]:
            self._files.delete(self._at(f"manifests/{v}.json"), False)
        gone = 0
        for made in self._files.listStatus(self._at("data")) if self._files.exists(self._at("data")) else ():
            name = made.getPath().getName()
            own = [f.getPath().getName() for f in self._files.listStatus(made.getPath())]
            for folder in own:
                if folder.startswith("_bucket=") and f"data/{name}/{folder}" not in used:
                    gone += self._files.delete(self._at(f"data/{name}/{folder}"), True)
            if not any(f"data/{name}/{folder}" in used for folder in own):
                self._files.delete(made.getPath(), True)
        return gone
