"""SimHash near-duplicates, linked by anchor points of a covering code.

The fingerprint's 64 bits lie in parts. Two fingerprints that differ in at most ``t`` bits differ in at most ``s`` bits
of some part, where the parts' reaches ``s`` are dealt so that all of ``s + 1`` together are ``t + 1``. A part's anchors
are the words of a code: Hamming's perfect code on as many of its bits as one has (15 or 31), all words on the others.
Each word of a part is within the covering radius of 1 of just one anchor, its home. A fingerprint goes to its home,
and as a visitor to every anchor within the covering radius plus ``s``: whoever is within ``s`` of it has its home
there. (An anchor's free bits cost a visitor one of ``s`` each, as the code only covers the others.) At an anchor each
visitor is compared with those at home, in blocks.

The anchors grow with the corpus. Three parts have 2 ** 17 or 2 ** 18 anchors each, and cost a fingerprint 34 rows at a
threshold of 4; two parts have 2 ** 27 each and cost 195 rows or so. The layout is chosen by the number of different
fingerprints, as that of the least cost: more rows, or more at home at each anchor.

Equal fingerprints are one before that. An anchor passes on a spanning forest of its links, in which no fingerprint has
more than 64 below it, not all pairs. An anchor with more than ``cell`` at home or visiting is split: its homes and its
visitors are dealt to rows and columns of a grid by hash, and each cell of the grid is compared on its own.

Components are those of nodes (least id, fingerprint), so that the least node of a component is its answer and nothing
is joined by component.

Defined results: a null or empty text has no words and the fingerprint zero, which is linked like any other. A null
id counts as a row of its own and is never the least of a component unless all its ids are null. Repeated rows share
a fingerprint and so a component. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.llm.components import components
from lumibase.llm.shared import materialize, small_batches, text_or_empty

SHINGLE, SEED, BITS = 4, 42, 64
#: What a row at an anchor costs, in comparisons of two fingerprints.
ROW_COST = 500
#: How many links of a forest may hang below one fingerprint.
FAN_OUT = 64
#: Over so many tasks the rows of one fingerprint are dealt.
SALTS = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Row b has the bits of the byte b, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: str) -> int:
    """The 64-bit fingerprint: a bit is set if more than half of the shingles' XXH64 have it."""
    import xxhash

    words = WORD.findall(text.encode().translate(LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a hash of the text) and fp: the fingerprint as a signed bigint of the same bits."""
    small_batches(df.sparkSession)
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col), F.xxhash64(text).alias("row"), text.alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter(map(simhash, batch.column(2).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=[id_col, "row", "fp"])

    return rows.mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, row bigint, fp bigint")


@dataclass(frozen=True)
class Part:
    """Some bits of the fingerprint. The Hamming code with ``checks`` check bits is on the lowest ``coded`` of them."""

    first: int
    width: int
    reach: int

    @cached_property
    def checks(self) -> int:
        return (self.width + 1).bit_length() - 1

    @cached_property
    def coded(self) -> int:
        return (1 << self.checks) - 1

    @property
    def anchors(self) -> int:
        return 1 << (self.width - self.checks)

    def of(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.first)) & np.uint64((1 << self.width) - 1)

    def homes(self, words: np.ndarray) -> np.ndarray:
        """The anchor within one bit of each word: the syndrome is the place of the coded bit that is off, or 0."""
        off = np.zeros_like(words)
        for k in range(self.checks):
            mask = sum(1 << (place - 1) for place in range(1, self.coded + 1) if place >> k & 1)
            off |= (np.bitwise_count(words & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
        return words ^ np.where(off > 0, np.uint64(1) << (np.maximum(off, np.uint64(1)) - np.uint64(1)), np.uint64(0))

    def visited(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (indices, anchors): all anchors that can be the home of a word within the reach, once each.

        These are the homes of all words within the reach: for each choice of flips, the home of the flipped word."""
        flips = np.array([sum(1 << p for p in places) for n in range(self.reach + 1) for places in combinations(range(self.width), n)], np.uint64)
        found = np.sort(self.homes(words[:, None] ^ flips[None, :]), axis=1)
        once = np.ones(found.shape, bool)
        once[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(once)[0], found[once]


def layout(threshold: int, parts: int) -> list[Part]:
    """Parts with reaches such that all ``reach + 1`` together are ``threshold + 1``; a part that isn't needed is left out."""
    widths = [64 // parts + (n < 64 % parts) for n in range(parts)]
    reaches = [(threshold + 1) // parts - 1 + (n < (threshold + 1) % parts) for n in range(parts)]
    found, first = [], 0
    for width, reach in zip(widths, reaches, strict=True):
        if reach >= 0:
            found.append(Part(first, width, reach))
        first += width
    return found


def cheapest_layout(threshold: int, fingerprints: int, choices: tuple[int, ...] = (3, 2)) -> list[Part]:
    """The layout of the least cost for so many different fingerprints."""

    def cost(parts: list[Part]) -> float:
        some = _RANDOM_WORDS
        return sum(len(p.visited(p.of(some))[0]) / len(some) * (ROW_COST + fingerprints / p.anchors) for p in parts)

    return min((layout(threshold, n) for n in choices), key=cost)


_RANDOM_WORDS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 256, np.uint64)


def _dealt(batch: pa.RecordBatch, parts: list[Part]) -> pa.RecordBatch:
    """Rows (anchor, visitor, fp): where each fingerprint is at home (visitor 0) and where it visits (1)."""
    fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
    out = []
    for number, part in enumerate(parts):
        words = part.of(fps)
        for visitor, (at, anchor) in enumerate(((np.arange(len(fps)), part.homes(words)), part.visited(words))):
            out.append((anchor.astype(np.int64) << 2 | number, np.full(len(at), visitor, np.int8), fps[at].view(np.int64)))
    columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "visitor", "fp"])


def _forest(homes: np.ndarray, visitors: np.ndarray, threshold: int, block: int = 64) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between homes and visitors of one anchor, compared block by block. What a
    fingerprint newly connects hangs below it as a tree, not as a star, so that no fingerprint is in very many links."""
    nodes = np.unique(np.concatenate((homes, visitors)))
    label = np.arange(len(nodes))
    there = np.searchsorted(nodes, visitors)
    for first in range(0, len(homes), block):
        near = np.bitwise_count(homes[first : first + block, None] ^ visitors[None, :]) <= threshold
        for x, row in zip(homes[first : first + block], near, strict=True):
            own = label[np.searchsorted(nodes, x)]
            hit = there[row]
            apart = hit[label[hit] != own]
            if len(apart):
                others, one_each = np.unique(label[apart], return_index=True)
                tree = [int(x), *nodes[apart[one_each]].tolist()]
                yield from ((tree[(n - 1) // FAN_OUT], tree[n]) for n in range(1, len(tree)))
                label[np.isin(label, others)] = own


def _compared(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (anchor, row, column, visitor, fp) that come sorted by all but the last.

    Small anchors, nearly all of them, are compared together: each visitor with each of its anchor's homes."""

    def emit(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(c) if pairs else np.empty(0, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def groups(keys: np.ndarray, visitor: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        sizes = np.diff(np.append(edge, len(keys)))
        homes = np.add.reduceat((visitor == 0).astype(np.int64), edge)
        pairs = []
        small = homes * (sizes - homes) <= 4096
        # small groups at once: visitor k of a group meets its homes number 0, 1, ...
        at = np.repeat(np.flatnonzero(small), (sizes - homes)[small])
        first, count = edge[at], homes[at]
        own = np.arange(len(at)) - np.repeat(np.cumsum((sizes - homes)[small]) - (sizes - homes)[small], (sizes - homes)[small])
        who = first + count + own
        for n in range(int(count.max(initial=0))):
            more = count > n
            x, y = fps[first[more] + n], fps[who[more]]
            hit = (np.bitwise_count(x ^ y) <= threshold) & (x < y)
            pairs.append((x[hit].view(np.int64), y[hit].view(np.int64)))
        for g in np.flatnonzero(~small):
            a, n, m = edge[g], homes[g], sizes[g]
            links = np.array(list(_forest(fps[a : a + n], fps[a + n : a + m], threshold)), np.uint64).reshape(-1, 2)
            pairs.append((links[:, 0].view(np.int64), links[:, 1].view(np.int64)))
        return emit(pairs)

    held: list[np.ndarray] = []  # the last group may go on in the next batch
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        rows = np.stack(columns, axis=1)
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        cut = cut[-1] + 1 if len(cut) else 0
        if held and (cut or (held[0][0, :3] != rows[0, :3]).any()):
            done = np.concatenate([*held, rows[:cut]])
            held = []
            yield groups(done[:, :3], done[:, 3], np.ascontiguousarray(done[:, 4]).view(np.uint64))
        elif cut:
            yield groups(rows[:cut, :3], rows[:cut, 3], np.ascontiguousarray(rows[:cut, 4]).view(np.uint64))
        held.append(rows[cut:])
    if held:
        done = np.concatenate(held)
        yield groups(done[:, :3], done[:, 3], np.ascontiguousarray(done[:, 4]).view(np.uint64))


def links(fps: DataFrame, threshold: int = 4, cell: int = 4096, parts: int | None = None) -> DataFrame:
    """Links (u, v) between different fingerprints (column fp, each once) that differ in at most ``threshold`` bits:
    enough of them to connect all that are connected. ``parts`` (2 or 3) fixes the layout."""
    if not 0 <= threshold < 6:
        raise ValueError("anchors are laid out for thresholds from 0 to 5")
    laid = layout(threshold, parts) if parts else cheapest_layout(threshold, fps.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _dealt(batch, laid)

    small_batches(fps.sparkSession)
    dealt = materialize(fps.select("fp").mapInArrow(deal, "anchor bigint, visitor tinyint, fp bigint"), "anchors")
    crowded = (
        dealt.groupBy("anchor").agg(F.count_if(F.expr("visitor = 0")).alias("homes"), F.count_if(F.expr("visitor = 1")).alias("visitors"))
        .where((F.col("homes") > cell) | ((F.col("homes") > 1) & (F.col("visitors") > cell)))
        .select("anchor", F.ceil(F.col("homes") / cell).alias("rows"), F.ceil(F.col("visitors") / cell).alias("columns"))
    )
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        placed = dealt.select("anchor", F.lit(0).alias("row"), F.lit(0).alias("column"), "visitor", "fp")
    else:
        # a crowded anchor has over `cell` of the fingerprints, each of which visits a fixed number of anchors: there are at most so many
        at_grid = dealt.join(crowded, "anchor", "left")
        own = lambda n: F.pmod(F.xxhash64("fp"), F.coalesce(F.col(n), F.lit(1))).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)).cast("int") - 1)
        row = F.when(F.col("visitor") == 0, F.array(own("rows"))).otherwise(every("rows"))
        column = F.when(F.col("visitor") == 1, F.array(own("columns"))).otherwise(every("columns"))
        placed = at_grid.withColumn("row", F.explode(row)).withColumn("column", F.explode(column)).select("anchor", "row", "column", "visitor", "fp")
    sorted_rows = placed.repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column", "visitor")
    return sorted_rows.mapInArrow(lambda batches: _compared(batches, threshold), "u bigint, v bigint").distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 4) -> DataFrame:
    """Per row: id, row (a hash of the text), fp, root (the fingerprint with the component's least id) and component_id
    (the least id that its fingerprint reaches)."""
    prints = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("fp"))
    nodes = lambda end: classes.select(F.col("fp").alias(end), node.alias(f"node_{end}"))
    edges = links(classes, threshold).join(nodes("u"), "u").join(nodes("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    members = components(edges).select(F.col("u.fp").alias("fp"), F.col("v").alias("first"))
    of_print = classes.join(members, "fp", "left").withColumn("first", F.coalesce("first", node))
    of_print = of_print.select("fp", F.col("first.fp").alias("root"), F.col("first.least").alias("component_id"))
    # a fingerprint that very many rows share is dealt over several tasks
    salted = prints.withColumn("salt", F.pmod(F.xxhash64(id_col, "row"), F.lit(SALTS)))
    every = of_print.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["fp", "salt"]).select(id_col, "row", "fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
