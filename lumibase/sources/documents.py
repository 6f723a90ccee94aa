"""The decision document that lies on a drive, as rows and back.

A document is one JSON object: format, written, drive (uuid, label, notes), settings (an object), and the lists trips, events,
skipped_clusters, date_confirmations and albums. Whatever else it has comes from a newer version and goes through
unchanged, as do fields of a list's entries that nothing here knows: entries are VARIANT values.

A row is a drive, when its document was written, a section, a place in it, a key and the item. A setting's key is its name;
an unknown section is one row of the section ``unknown``, whose key is its name.

Written documents are lines of text, an entry a line, sorted by drive, section and place, so that a document is never held
as a whole: what a line needs of others is whether its section goes on. Read documents are parsed one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.operators.decisions import is_machine_local

FORMAT = 1
# The names that a document has, and the key of each list's entries.
LISTS = {"trips": "$.days", "events": "$.signature", "skipped_clusters": "$", "date_confirmations": "$.sha256", "albums": "$.name"}
KNOWN = ("format", "written", "drive", "settings", *LISTS)
SECTIONS = ("unknown", "settings", *LISTS)


def _get(value: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _quoted(text: Column) -> Column:
    """A text as JSON writes it: a list of it without the brackets."""
    made = F.to_json(F.array(text))
    return made.substr(F.lit(2), F.char_length(made) - 2)


def parse_documents(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """drive_uuid, label, notes, written, section, place, key and item of documents as texts. A text that isn't a JSON object
    gives no rows; a section that is absent or of another type is empty."""
    whole = texts.select(F.try_parse_json(text_col).alias("doc")).where("schema_of_variant(doc) LIKE 'OBJECT<%'")
    entries = F.expr("try_cast(doc AS map<string, variant>)")
    of = whole.select(
        F.coalesce(_get("doc", "$.drive.uuid"), F.lit("")).alias("drive_uuid"), _get("doc", "$.drive.label").alias("label"), _get("doc", "$.drive.notes").alias("notes"),
        F.nullif(_get("doc", "$.written"), F.lit("")).alias("written"), "doc", entries.alias("entries"),
    )
    named = lambda section, items: F.transform(items, lambda item, n: F.struct(F.lit(section).alias("section"), n.alias("place"), F.when(F.lit(section).isin(*LISTS), _get(item, LISTS.get(section, "$"))).alias("key"), item.alias("item")))
    pairs = lambda section, held: F.transform(F.map_entries(held), lambda e: F.struct(F.lit(section).alias("section"), F.lit(0).alias("place"), e["key"].alias("key"), e["value"].alias("item")))
    parts = [named(name, _get("doc", f"$.{name}", "array<variant>")) for name in LISTS]
    parts.append(pairs("settings", _get("doc", "$.settings", "map<string, variant>")))
    parts.append(pairs("unknown", F.map_filter("entries", lambda k, _: ~k.isin(*KNOWN))))
    kind = "array<struct<section: string, place: int, key: string, item: variant>>"
    rows = F.concat(*(F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts))
    return of.select("drive_uuid", "label", "notes", "written", F.explode_outer(rows).alias("r")).select("drive_uuid", "label", "notes", "written", "r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.text(path, wholetext=True))


def document_lines(rows: DataFrame) -> DataFrame:
    """drive_uuid and value: the lines of each drive's document, in order and in one partition. Settings that belong to one
    machine are left out. A drive with no rows but one without a section has a document with empty sections."""
    kept = rows.where(F.col("section").isNotNull() & ~((F.col("section") == "settings") & is_machine_local(F.col("key"))))
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    text = F.to_json("item")
    named = F.concat(_quoted(F.col("key")), F.lit(": "), text)
    items = kept.select("drive_uuid", number.alias("number"), "place", "key", F.when(F.col("section").isin("unknown", "settings"), named).otherwise(text).alias("line"))
    order = W.partitionBy("drive_uuid", "number").orderBy("place", F.col("key").asc_nulls_first(), "line")
    last = F.lead(F.lit(1)).over(order).isNull() & (F.col("number") > 1)  # behind the unknown sections others follow
    items = items.withColumn("line", F.concat(F.when(F.col("number") > 1, F.lit("  ")).otherwise(""), "line", F.when(last, "").otherwise(",")))
    drives = rows.groupBy("drive_uuid").agg(F.max("label").alias("label"), F.max("notes").alias("notes"), F.max("written").alias("written"))
    drive = F.struct(F.col("drive_uuid").alias("uuid"), "label", "notes")
    head = F.concat(F.lit(f'"format": {FORMAT},\n"written": '), _quoted(F.coalesce("written", F.lit(""))), F.lit(',\n"drive": '), F.to_json(drive, {"ignoreNullFields": "false"}), F.lit(","))
    line = lambda number, side, text: F.struct(F.lit(number).alias("number"), F.lit(side).alias("side"), text.alias("line"))
    frame = [line(0, 0, F.lit("{")), line(1, 2, head)]
    for n, section in enumerate(SECTIONS[1:], 2):
        opening, closing = "{}" if section == "settings" else "[]"
        frame += [line(n, 0, F.lit(f'"{section}": {opening}')), line(n, 2, F.lit(closing + ("," if n < len(SECTIONS) else "\n}")))]
    edges = drives.select("drive_uuid", F.explode(F.array(*frame)).alias("f")).select("drive_uuid", "f.number", "f.side", F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"), "f.line")
    lines = items.withColumn("side", F.lit(1)).select(*edges.columns).unionByName(edges)
    placed = lines.repartition("drive_uuid").sortWithinPartitions("drive_uuid", "number", "side", "place", F.col("key").asc_nulls_first(), "line")
    return placed.select("drive_uuid", F.col("line").alias("value"))


def write_documents(rows: DataFrame, path: str) -> None:
    """Each drive's document in a folder of its own."""
    document_lines(rows).withColumnRenamed("drive_uuid", "drive").write.mode("overwrite").partitionBy("drive").text(path)
