"""Suffix-array deduplication: bytes that a string of ``least`` bytes covers which also starts earlier are removed.

A start is removed by its longest previous factor: of all suffixes in order, the previous and the next smaller
position give the longest match that begins earlier; if that has ``least`` bytes, the bytes from the start on are
covered. One suffix array of a corpus doesn't fit a worker, so the corpus is first cut to what can match at all:

1. Each worker finds the runs of windows with a common anchor (see ``suffixes``). Runs of equal bytes within a batch
   are repeats of the first of them. One of each goes on, packed, to the bucket of its anchor.
2. There, of runs of equal bytes, all but the first are repeats. Anchors that have runs of different bytes go on.
3. The bytes of these runs are taken from the texts and gathered by anchor. Their suffixes are put in order by prefix
   doubling; previous and next smaller positions give the array of longest previous factors, and so the repeated
   windows across runs of different bytes (copies that differ around the anchor).
4. All repeated windows of a text are joined to it, and the bytes that they cover removed.

Runs count as equal if the 64-bit hashes of their anchors and of their bytes are. An anchor with more than ``crowd``
different runs (half a MB of them) doesn't fit one suffix array. Its windows are put in order by name instead: a name stands
for the first ``least`` bytes of a suffix, as a rank of prefix doubling does, but is a 128-bit hash, so that names are
dealt over all workers and no anchor, however common, has to be in one place. Within a name, the previous smaller
position is the window before. An anchor with many different runs in one batch (a 64th of ``crowd``) is already dealt
over many buckets in step 1; a sign tells the anchor's own bucket so.

The number of buckets grows with the bytes of the texts, so that a bucket's size does not.

Strings are bytes of one text each. Order is by id, then by start. Defined results: a null or empty text has no bytes.
A null id comes before all others. Rows that repeat an id but not the text are documents in the order of a hash of
their texts; rows that repeat both are one document and get the same result. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.llm import suffixes
from lumibase.llm.shared import materialize, small_batches, text_or_empty

RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("key", "<i8"), ("first", "<u4"), ("count", "<u4"), ("kind", "u1")])
#: Kinds of packed runs: of the anchor's own bucket, of a crowded anchor, and the sign that an anchor is crowded.
OWN, CROWDED, SIGN = range(3)
WINDOW = np.dtype([("content", "<u8"), ("anchor", "<u8"), ("key", "<i8"), ("first", "<u4")])
SALTS = np.uint64(61)
#: Bytes of runs in one suffix array, of texts for each bucket of packed runs, and of texts in a task that joins them.
ARRAY_BYTES, BUCKET_BYTES, TASK_BYTES = 512 << 10, 16 << 20, 64 << 20
#: More tasks than so many cost the driver more than they save; they then hold more each, and spill.
MOST_TASKS = 40_000
SPAN_SCHEMA = "key bigint, first bigint, count bigint"


def _spans(key: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, first, count)], names=["key", "first", "count"])


def _by_bucket(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edges = np.flatnonzero(suffixes.changes(bucket))
    for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
        yield int(bucket[a]), rows[a:b].tobytes()


def _found_runs(batches: Iterator[pa.RecordBatch], least: int, buckets: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """(key, raw) -> (bucket, packed): packed runs for a bucket; bucket -1: a text's own repeats within the batch."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        text, first, count, anchor, content = suffixes.batch_runs(batch.column(1).to_pylist(), least)
        runs = np.zeros(len(text), RUN)
        runs["anchor"], runs["content"], runs["key"], runs["first"], runs["count"] = anchor, content, keys[text], first, count
        runs = runs[np.lexsort((runs["first"], runs["key"], content, anchor))]
        same = ~suffixes.changes(runs["anchor"], runs["content"]) if len(runs) else np.zeros(0, bool)
        # rows of one key hold one text, so equal places are no repeats of each other
        again = same & suffixes.changes(runs["key"], runs["first"]) if len(runs) else same
        repeats, runs = runs[again], runs[~same]
        new = suffixes.changes(runs["anchor"]) if len(runs) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        crowded = (np.bincount(group) > max(1, crowd // 64))[group] if len(runs) else new
        runs["kind"] = np.where(crowded, CROWDED, OWN)
        signs = runs[crowded & new]
        signs["kind"] = SIGN
        salt = np.where(crowded, runs["content"] % SALTS + np.uint64(1), np.uint64(0))
        bucket = np.concatenate(((runs["anchor"] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets), signs["anchor"] % np.uint64(buckets))).astype(np.int64)
        packed = list(_by_bucket(np.concatenate((runs, signs)), bucket))
        if len(repeats):
            packed.append((-1, repeats.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), pa.array([p for _, p in packed], pa.binary())], names=["bucket", "packed"])


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """Rows (bucket, packed) sorted by bucket -> the whole of each bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at and held:
                yield at, np.concatenate(held)
                held = []
            at = bucket
            held.append(np.frombuffer(packed, kind))
    if held:
        yield at, np.concatenate(held)


def _sorted_out(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Packed runs -> (key, first, count, anchor, crowded): repeats have no anchor, runs to be compared have one."""
    for bucket, runs in _gathered(batches, RUN):
        if bucket < 0:
            yield _needs(runs, runs[:0], np.zeros(0, bool))
            continue
        # crowded runs are groups of their own, but share the bucket's order
        runs = runs[np.lexsort((runs["first"], runs["key"], runs["content"], runs["kind"] == CROWDED, runs["anchor"]))]
        signs = runs["kind"] == SIGN
        new = suffixes.changes(runs["anchor"], runs["kind"] == CROWDED)
        group = np.cumsum(new) - 1
        signed = np.bincount(group, weights=signs) > 0
        runs, group = runs[~signs], group[~signs]
        if not len(runs):
            continue
        different = suffixes.changes(group, runs["content"])
        kinds = np.bincount(group, weights=different, minlength=len(signed))
        crowded = ((kinds > crowd) | signed)[group] | (runs["kind"] == CROWDED)
        compare = different & (crowded | (kinds > 1)[group])
        repeat = ~different & suffixes.changes(group, runs["content"], runs["key"], runs["first"])
        yield _needs(runs[repeat], runs[compare], crowded[compare])


def _needs(repeats: np.ndarray, compare: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate((repeats, compare))
    anchor = pa.array(both["anchor"].view(np.int64) if len(both) else np.empty(0, np.int64), mask=np.arange(len(both)) < len(repeats))
    flags = pa.array(np.concatenate((np.zeros(len(repeats), bool), crowded)))
    columns = [*_spans(both["key"], both["first"], both["count"]).columns, anchor, flags]
    return pa.RecordBatch.from_arrays(columns, names=["key", "first", "count", "anchor", "crowded"])


def _taken(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(runs, key, raw, ...) -> (bucket, anchor, key, first, data): the bytes of runs by anchor, and the packed windows of
    crowded anchors by hash (these without an anchor)."""
    for batch in batches:
        rows, windows = [], []
        for runs, key, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            for run in runs:
                first, count, anchor = run["first"], run["count"], run["anchor"]
                data = raw[first : first + count + least - 1]
                if not run["crowded"]:
                    rows.append((anchor, anchor, key, first, data))
                    continue
                own = np.zeros(count, WINDOW)
                at = np.arange(count)
                own["content"] = suffixes.Spans(np.frombuffer(data, np.uint8)).of(at, at + least)
                own["anchor"], own["key"], own["first"] = np.array(anchor).view(np.uint64), key, first + at
                windows.append(own)
        if windows:
            windows = np.concatenate(windows)
            rows += [(bucket, None, None, None, packed) for bucket, packed in _by_bucket(windows, (windows["content"] % np.uint64(buckets)).astype(np.int64))]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "anchor", "key", "first", "data"])


def _stretches(key: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Repeated windows, sorted by key and place, as stretches of neighbours."""
    edge = np.ones(len(key), bool)
    edge[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(edge)
    return _spans(key[at], first[at], np.diff(np.append(at, len(key))))


def _compared(batches: Iterator[pa.RecordBatch], least: int, enough: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, anchor, key, first, data) sorted by bucket and anchor -> repeated windows. Anchors share a suffix
    array until there are ``enough`` bytes; equal windows of different anchors don't exist."""

    def match(runs: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        rows = sorted(runs.items())
        counts = np.fromiter((len(d) - least + 1 for _, d in rows), np.int64, len(rows))
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        key = np.repeat(np.fromiter((k for (k, _), _ in rows), np.int64, len(rows)), counts)
        first = np.repeat(np.fromiter((f for (_, f), _ in rows), np.int64, len(rows)), counts) + within
        hit = suffixes.previous_matches([d for _, d in rows], least)
        return _stretches(key[hit], first[hit])

    def hashed(windows: np.ndarray) -> pa.RecordBatch:
        windows = windows[np.lexsort((windows["first"], windows["key"], windows["anchor"], windows["content"]))]
        hit = windows[~suffixes.changes(windows["content"], windows["anchor"]) & suffixes.changes(windows["key"], windows["first"])]
        hit = hit[np.lexsort((hit["first"], hit["key"]))]
        return _stretches(hit["key"], hit["first"].astype(np.int64))

    # rows of one key hold one text, so a run that comes again at its place is no repeat
    rows, size, group = {}, 0, None
    packed, bucket = [], None
    for batch in batches:
        for here, anchor, key, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor is None:
                if here != bucket and packed:
                    yield hashed(np.concatenate(packed))
                    packed = []
                bucket = here
                packed.append(np.frombuffer(data, WINDOW))
                continue
            if anchor != group and size >= enough:
                yield match(rows)
                rows, size = {}, 0
            group = anchor
            if (key, first) not in rows:
                rows[key, first] = data
                size += len(data)
    if rows:
        yield match(rows)
    if packed:
        yield hashed(np.concatenate(packed))


def _cut(batches: Iterator[pa.RecordBatch], least: int, whole_characters: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(raw, spans, others) -> (others, n_bytes, removed, kept)."""
    removed_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, removed, kept = [], [], []
        for raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            joined: list[list[int]] = []
            for first, end in sorted((s["first"], s["first"] + s["count"] + least - 1) for s in spans or ()):
                if joined and first <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], end)
                else:
                    joined.append([first, end])
            if whole_characters:
                for span in joined:
                    while span[0] < span[1] and raw[span[0]] & 0xC0 == 0x80:
                        span[0] += 1
                    while span[1] < len(raw) and span[0] < span[1] and raw[span[1]] & 0xC0 == 0x80:
                        span[1] -= 1
            out, at = [], 0
            for first, end in joined:
                out.append(raw[at:first])
                at = end
            out.append(raw[at:])
            sizes.append(len(raw))
            removed.append([tuple(s) for s in joined])
            kept.append(b"".join(out))
        made = [pa.array(sizes, pa.int64()), pa.array(removed, removed_type), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*names, "n_bytes", "removed", "kept"])


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds a key, never null, that is unique to an id and its text, and in the order of both."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    if docs.groupBy(key.alias("key")).count().where("count > 1").isEmpty():
        return docs.withColumn("key", key)
    content = F.xxhash64("raw")
    # partitions of a sorted table are in order, so these numbers are too
    numbers = docs.select(key.alias("_id"), content.alias("_content")).distinct().orderBy("_id", "_content").withColumn("key", F.monotonically_increasing_id())
    numbers = materialize(numbers, "keys")
    return docs.withColumns({"_id": key, "_content": content}).join(numbers, ["_id", "_content"]).drop("_id", "_content")


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100, crowd: int | None = None, whole_characters: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: id, the columns to carry, n_bytes, removed (spans of bytes: start, end) and kept (the remaining bytes).

    With ``whole_characters`` spans are narrowed to whole characters, so that what is kept is UTF-8."""
    if least < suffixes.GRAM:
        raise ValueError(f"strings of fewer than {suffixes.GRAM} bytes have no anchor")
    spark = df.sparkSession
    small_batches(spark)
    crowd = crowd or max(1, ARRAY_BYTES // (2 * least))
    others = [f"other{n}" for n in range(1 + len(carry))]  # names of their own, as the caller's may clash
    rows = df.select(text_or_empty(text_col).cast("binary").alias("raw"), *(F.col(c).alias(o) for c, o in zip((id_col, *carry), others, strict=True)))
    docs = _keyed(rows, others[0]).select("key", "raw", *others)
    size, parallel = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = max(2 * parallel, size // BUCKET_BYTES), min(size // TASK_BYTES, MOST_TASKS)

    def deal(df: DataFrame, column) -> DataFrame:
        return df.repartition(tasks, column) if tasks > parallel else df.repartition(column)

    packed = docs.select("key", "raw").mapInArrow(lambda b: _found_runs(b, least, buckets, crowd), "bucket bigint, packed binary")
    dealt = F.when(F.col("bucket") < 0, F.xxhash64("packed")).otherwise(F.col("bucket"))
    ordered = deal(packed, dealt).sortWithinPartitions("bucket")
    sorted_out = materialize(ordered.mapInArrow(lambda b: _sorted_out(b, crowd), f"{SPAN_SCHEMA}, anchor bigint, crowded boolean"), "runs")

    asked = sorted_out.where("anchor IS NOT NULL").groupBy("key").agg(F.collect_list(F.struct("first", "count", "anchor", "crowded")).alias("runs"))
    if tasks > parallel:
        docs = docs.repartition(tasks, "key")
    # the texts are dealt by key once: both joins read the same exchange, so both have the same columns
    asked_rows = docs.join(asked, "key").select("runs", "key", "raw", *others)
    taken = asked_rows.mapInArrow(lambda b: _taken(b, least, buckets), "bucket bigint, anchor bigint, key bigint, first bigint, data binary")
    matched = deal(taken, F.col("bucket")).sortWithinPartitions("bucket", "anchor").mapInArrow(lambda b: _compared(b, least), SPAN_SCHEMA)

    spans = sorted_out.where("anchor IS NULL").select("key", "first", "count").union(matched)
    of_text = spans.groupBy("key").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    joined = docs.join(of_text, "key", "left").select("raw", "spans", *others)
    names = [id_col, *carry]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary"])
    return joined.mapInArrow(lambda b: _cut(b, least, whole_characters, names), schema)
