"""Export sidecars: matching them to media files, and what an ingest takes from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.functions import paths
from lumibase.operators.stages import written

# Fixed value: a supplemental sidecar's name, which exports cut off.
SUPPLEMENTAL = r"(?i)^(.+?)\.supp[a-z-]*(\(\d+\))?\.json$"


def sidecar_keys(sidecars: DataFrame) -> DataFrame:
    """Keys under which a sidecar (folder, name) is found: tier 0 its exact base, tier 1 its supplemental base."""
    name = F.col("name")
    key = F.concat(F.regexp_extract(name, SUPPLEMENTAL, 1), F.regexp_extract(name, SUPPLEMENTAL, 2))
    tier = lambda n, key: F.struct(F.lit(n).alias("tier"), key.alias("key"))
    exact = F.when(name.endswith(".json"), tier(0, F.regexp_replace(name, r"\.json$", "")))
    more = F.when(F.lower(name).contains(".supp") & name.rlike(SUPPLEMENTAL), tier(1, key))
    return sidecars.select("folder", "name", F.explode(F.array(exact, more)).alias("k")).where("k IS NOT NULL").select("folder", "name", "k.tier", "k.key")


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media (folder, name) with the sidecar of the best base name: all exact ones before any supplemental one.
    Null where there is none."""
    media = written(media.select("folder", "name"), "media")  # read twice
    bases = media.select("folder", F.col("name").alias("media"), F.posexplode(paths.sidecar_bases(F.col("name"))).alias("pos", "key"))
    # a number first, as a sort compares folders and names only where their numbers are equal
    hashed = lambda df: df.withColumn("hash", F.xxhash64("folder", "key"))
    hits = hashed(bases).join(hashed(sidecar_keys(sidecars)), ["hash", "folder", "key"])
    best = hits.groupBy("folder", "media").agg(F.min_by("name", F.struct("tier", "pos", "name")).alias("sidecar"))
    return media.select("folder", F.col("name").alias("media")).join(best, ["folder", "media"], "left")


def ingest_writes(matched: DataFrame) -> DataFrame:
    """What is written into a file: the date if it came from the sidecar, the place if none is embedded, and any
    description. Rows have date_source, taken_at, lat, lon, embedded_lat, description; files without a write have none."""
    date = F.when(F.col("date_source").isin("takeout", "takeout_upload"), F.col("taken_at"))
    place = F.when(F.col("embedded_lat").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    rows = matched.select("path", date.alias("write_date"), place.alias("write_place"), F.nullif(F.trim("description"), F.lit("")).alias("write_description"))
    return rows.where("write_date IS NOT NULL OR write_place IS NOT NULL OR write_description IS NOT NULL")


def aggregate_albums(members: DataFrame) -> DataFrame:
    """All albums of a content."""
    return members.groupBy("sha256").agg(F.array_sort(F.collect_set("album")).alias("albums"))


def ingest_report(resolved: DataFrame) -> DataFrame:
    """Kept, collapsed, bytes freed and missing sidecars, per source of the date."""
    return resolved.groupBy("date_source").agg(
        F.count_if(F.col("kind") != "exact").alias("kept"),
        F.count_if(F.col("kind") == "exact").alias("collapsed"),
        F.coalesce(F.sum(F.when(F.col("kind") == "exact", F.col("size"))), F.lit(0)).alias("freed"),
        F.count_if(F.col("sidecar").isNull()).alias("missing_sidecars"),
    )
