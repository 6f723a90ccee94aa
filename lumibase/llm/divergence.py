"""A divergence audit of sources: which sources of a language differ in their words, and by which words.

Terms are runs of A-Z, a-z and characters beyond ASCII, of which only A-Z are lower-cased. A language keeps its
vocabulary: the terms that enough of its documents have. Smoothed shares p (in units of 1e-9, integers) of each group
(language and source) and each language are compared term by term with ``f = (p - q)^2 div (p + q)``.

The sum of f over the vocabulary for each pair of a language's sources comes from run-length columns. The vocabulary is
reordered by the terms' vectors of counts, by a range shuffle, so that equal counts lie together; each chunk of the order is
encoded as a column of runs for each group. For a pair the boundaries of both columns' runs are intersected, and f is
multiplied by the length of each common run. Chunks are summed by pair. A chunk is closed by its number of terms and of
counts above zero, so what a task holds at once is bounded. What is said of all pairs of sources is as large as the result
itself.

Texts are counted where they lie, before anything is shuffled, so a source or a term that very many rows have costs no more
than others. All arithmetic is exact: counts times 1e9 are decimals or Python integers where 64 bits don't do.

Defined results: null languages, sources and texts count as ''. A group without terms has the smoothed share of no
counts; a language without a vocabulary has pairs of value 0 and no term. Rows that repeat count each. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumibase.llm.shared import materialize, small_batches, text_or_empty

UNIT = 1_000_000_000
#: In UTF-8, ASCII letters and all bytes of other characters stay (A-Z lower-cased), and other bytes part the terms.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different counts that a task holds before it hands them on, and what closes a chunk of the vocabulary.
HELD, CHUNK_TERMS, CHUNK_COUNTS = 200_000, 1 << 16, 1 << 20
#: Rows up to which the table of groups is broadcast.
BROADCAST_GROUPS = 200_000


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split(b" ")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (texts that have it), summed over what a task has read."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_with) in held.items():
                del n[b""], docs_with[b""]
                words = list(n)
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[w] for w in part], pa.int64()), pa.array([docs_with[w] for w in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(terms(raw))
                n.update(own)
                docs_with.update(own.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint")


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total and groups: the counts above zero as (source, n), in the order of sources."""
    # Dealt by language and term only, which serves both steps; the sources of a term are at most those of its language.
    dealt = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    grouped = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    return grouped.where(F.col("docs") >= least_docs).drop("docs")


def _encoded(ordered: DataFrame) -> DataFrame:
    """The vocabulary in its order as chunks: lang, length, and the columns of the sources that have a count in it, each
    as ends of runs and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("source", pa.string()), ("ends", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))
        lang_now, length, held, values = None, 0, {}, 0

        def closed() -> pa.RecordBatch:
            columns = []
            for source, (at, n) in held.items():
                dense = np.zeros(length, np.int64)
                dense[at] = n
                ends = np.append(np.flatnonzero(dense[1:] != dense[:-1]) + 1, length)
                columns.append({"source": source, "ends": ends.astype(np.int32), "counts": dense[ends - 1]})
            return pa.RecordBatch.from_arrays([pa.array([lang_now], pa.string()), pa.array([length], pa.int64()), pa.array([columns], kind)], names=["lang", "length", "columns"])

        for batch in batches:
            for lang, groups in zip(batch.column("lang").to_pylist(), batch.column("groups").to_pylist(), strict=True):
                if length and (lang != lang_now or length >= CHUNK_TERMS or values >= CHUNK_COUNTS):
                    yield closed()
                    length, held, values = 0, {}, 0
                lang_now = lang
                for g in groups:
                    at, n = held.setdefault(g["source"], ([], []))
                    at.append(length)
                    n.append(g["n"])
                length += 1
                values += len(groups)
        if length:
            yield closed()

    return ordered.select("lang", "groups").mapInArrow(work, "lang string, length bigint, columns array<struct<source: string, ends: array<int>, counts: array<bigint>>>")


def shares(counts: np.ndarray, whole: int, terms: int) -> np.ndarray:
    """Smoothed shares in units of 1e-9."""
    if len(counts) and int(counts.max()) > 9_000_000_000:
        counts = counts.astype(object)  # the product doesn't fit 64 bits
    return (1 + UNIT * (counts + 2) // (whole + 2 * terms)).astype(np.int64)


def run_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of f over two columns of (ends of runs, shares), run by common run."""
    ends = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    lengths = np.diff(ends, prepend=0)
    return int(((p - q) ** 2 // (p + q) * lengths).sum())


def _pair_sums(chunks: DataFrame) -> DataFrame:
    """lang, source, other (the later of the two) and the sum of f over the chunks that a task has read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lang, length, terms = row["lang"], row["length"], row["terms"]
                own = {c["source"]: c for c in row["columns"]}
                columns = []
                for g in row["sources"] if length else ():
                    c = own.get(g["source"], {"ends": [length], "counts": [0]})
                    columns.append((np.array(c["ends"], np.int64), shares(np.array(c["counts"], np.int64), g["whole"], terms)))
                names = [g["source"] for g in row["sources"]]
                for n, name in enumerate(names):
                    sums = [run_sum(columns[n], other) if length else 0 for other in columns[n + 1 :]] if length else [0] * (len(names) - n - 1)
                    if sums:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), pa.array([name] * len(sums)), pa.array(names[n + 1 :]), pa.array(sums, pa.int64())], names=["lang", "source", "other", "value"])

    return chunks.mapInArrow(work, "lang string, source string, other string, value bigint").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def _share(count: Column, whole: Column, terms: Column) -> Column:
    """As ``shares``, in exact decimals."""
    made = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (whole + 2 * terms).cast("decimal(19,0)"))
    return made.cast("long") + 1


def divergences(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` has all other sources of the language, part ``term`` the
    first ``top`` terms that the group uses more than its language."""
    rows = docs.select(text_or_empty(f"`{lang_col}`").alias("lang"), text_or_empty(f"`{source_col}`").alias("source"), text_or_empty(f"`{text_col}`").alias("text"))
    kept = materialize(vocabulary(term_counts(rows), least_docs), "vocabulary")
    used = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.n").alias("whole"))
    groups = rows.select("lang", "source").distinct().join(used, ["lang", "source"], "left").select("lang", "source", F.coalesce("whole", F.lit(0)).alias("whole"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    info = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "whole"))).alias("sources"), F.sum("whole").alias("lang_whole"))
    info = materialize(info.join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "groups")
    few = info.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("n")).first().n <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda df: df

    ordered = kept.repartitionByRange("lang", "groups", "term").sortWithinPartitions("lang", "groups", "term")
    columns = "array<struct<source: string, ends: array<int>, counts: array<bigint>>>"
    # every language has an empty chunk too, which gives each of its pairs a row
    chunks = _encoded(ordered).unionByName(info.select("lang", F.lit(0).cast("long").alias("length"), F.array().cast(columns).alias("columns")))
    sums = _pair_sums(chunks.join(small(info.select("lang", "sources", "terms")), "lang"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    single = info.select("lang", "lang_whole", "terms", F.explode("sources").alias("s")).select("lang", "s.source", "s.whole", "lang_whole", "terms")
    cells = kept.select("lang", "term", "total", F.explode("groups").alias("g")).select("lang", "g.source", "term", "g.n", "total").join(small(single), ["lang", "source"])
    shared = cells.select("lang", "source", "term", _share(F.col("n"), F.col("whole"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_whole"), F.col("terms")).alias("q"))
    over = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = over.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
