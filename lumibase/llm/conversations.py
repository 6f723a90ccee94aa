"""Conversation structure repair: faults of conversations, and the cheapest edits to an alternating form.

The role initials of a repaired conversation match ``(s?(ua)+)?``. Edits are Keep (0), Rerole to user or assistant (3),
Delete (4, required for blank and duplicate rows) and Insert an empty user or assistant turn (3); a truncated row that
is not deleted costs 3 more. Of all cheapest audits (the edits' initials in order) the least by ASCII is taken.

Rows are sorted by a range shuffle (conversation, turn, role, content) and numbered, without their texts, so that a
conversation with very many rows lies in many partitions. Blocks of ``2 ** BLOCK_BITS`` consecutive rows are aligned on
their own (Wagner-Fischer) with every string of the alternating grammar that leads from a state of the grammar to another
one and has a feasible length; Ukkonen bands follow from the cost of the best string so far, and strings of equal cost
are compared by their backtraced audits. A conversation within a block is then done. For the others two passes over the
blocks' few costs, with constant memory, choose the states between blocks. That is exact: an insert belongs to the row
that follows, so audits of a block that start in one state end in a row's letter and have equally many of these, and
the first block in which two audits differ decides.

Texts are shuffled once, at the end, and meet their edits in one pass over a conversation's sorted rows, of which one
row is held at a time.

Defined results: null roles and texts count as one space; a null id is an id like others, and null turns come first.
Rows of one turn are in the order of role and content hash. Content is told by 128 bits of a SHA-256. Other columns
are dropped. An empty table gives no rows, and a conversation all of whose rows are deleted has no repaired turns.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import materialize, small_batches

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\f\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 6
#: States of the grammar: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, DONE = range(4)
FAR = 1 << 40


def _after(state: int, letter: str) -> int:
    return SYSTEM if letter == "s" else USER if letter == "u" else DONE


def _targets(entry: int, length: int, system: bool) -> Iterator[tuple[str, int]]:
    """The grammar's strings of a length from a state on, and the state each leads to."""
    if length == 0:
        yield "", entry
        return
    plain = ("au" if entry == USER else "ua") * (length // 2 + 1)
    yield plain[:length], _after(entry, plain[length - 1])
    if entry == START and system:
        text = "s" + plain[: length - 1]
        yield text, _after(entry, text[-1])


def _deletes(most: int, cheap: int) -> int:
    """How many rows can be deleted at this cost above the least, where so many of them cost 1 and the others 4."""
    return most if most <= cheap else cheap + (most - cheap) // DELETE


def _align(symbols: str, target: str, most: int, last: bool) -> tuple[int, str] | None:
    """The least cost above what every alignment costs, and the least audit with it; None if it is over ``most``.

    Cell (i, j) is the cost from row i and letter j to the end. Rows b and d must go; upper case is truncated."""
    n, length = len(symbols), len(target)
    kept = [0]
    cheap = [0]
    for s in symbols:
        kept.append(kept[-1] + (s not in "bd"))
        cheap.append(cheap[-1] + s.isupper())
    rows, short = kept[-1], cheap[-1]
    inserts = most // INSERT
    nxt = [FAR] * (length + 2)
    nxt[length] = 0
    if last:
        for j in range(length - 1, -1, -1):
            nxt[j] = nxt[j + 1] + INSERT if target[j] != "s" else FAR
    table = [nxt]
    for i in range(n - 1, -1, -1):
        low = max(0, length - rows + kept[i] - inserts, kept[i] - _deletes(most, cheap[i]))
        high = min(length, kept[i] + inserts, length - rows + kept[i] + _deletes(most, short - cheap[i]))
        s = symbols[i]
        must, letter = s in "bd", s.lower()
        gone = 0 if must else DELETE - UNFINISHED if s.isupper() else DELETE
        cur = [FAR] * (length + 2)
        for j in range(high, low - 1, -1):
            best = nxt[j] + gone
            if j < length:
                t = target[j]
                if t != "s":
                    best = min(best, cur[j + 1] + INSERT)
                    if not must:
                        best = min(best, nxt[j + 1] + (0 if letter == t else REROLE))
                elif letter == t:
                    best = min(best, nxt[j + 1])
            cur[j] = best
        table.append(cur)
        nxt = cur
    cost = nxt[0]
    if cost > most or cost >= FAR:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < length:
        here = table[n - i]
        v = here[j]
        s = symbols[i] if i < n else ""
        if s and table[n - i - 1][j] + (0 if s in "bd" else DELETE - UNFINISHED if s.isupper() else DELETE) == v:
            audit.append("D")
            i += 1
        elif j < length and target[j] != "s" and (s or last) and here[j + 1] + INSERT == v:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if s.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 15)
def alignments(symbols: str, entry: int, last: bool) -> tuple[tuple[int, str] | None, ...]:
    """For each state at the end the least cost of a block that begins in a state, with the least audit.

    The last block may end in inserts, and only in a state that the grammar accepts."""
    rows = sum(s not in "bd" for s in symbols)
    short = sum(map(str.isupper, symbols))
    base = DELETE * (len(symbols) - rows) + UNFINISHED * short
    best: list[tuple[int, str] | None] = [None] * 4

    def tried(target: str, end: int) -> None:
        found = _align(symbols, target, best[end][0] if best[end] else FAR, last)
        if found and (best[end] is None or found < best[end]):
            best[end] = found

    if entry == START:
        tried("", START)
    if entry == SYSTEM and not last:
        tried("", SYSTEM)
    system = entry == START and "s" in symbols.lower()
    if system and not last:
        tried("s", SYSTEM)
    ends = (DONE,) if last else (USER, DONE)

    def worth(k: int, end: int) -> bool:
        """Whether a length that is off by k can be as good as what was found."""
        least = INSERT * k if k > 0 else min(-k, short) + max(0, -k - short) * DELETE
        return best[end] is None or least <= best[end][0]

    off = 0
    while any(worth(k, e) for k in (off, -off) for e in ends if rows + k >= 0):
        for k in dict.fromkeys((off, -off)):
            for target, end in _targets(entry, rows + k, system) if rows + k >= 0 else ():
                if end in ends and worth(k, end):
                    tried(target, end)
        off += 1
    return tuple(None if b is None else (b[0] + base, b[1]) for b in best)


def _choice(options: list[tuple[int, str] | None], ahead: list[int]) -> tuple[int, int, str]:
    """The end with the least cost in all, and of these the least audit: (end, cost, audit)."""
    total = min(o[0] + a for o, a in zip(options, ahead, strict=True) if o)
    return min(((e, *o) for e, (o, a) in enumerate(zip(options, ahead, strict=True)) if o and o[0] + a == total), key=lambda x: x[2])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _content(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and the content hash."""
    one = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    named = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    return named.withColumn("content", _content(F.col("role"), F.col("text")))


ORDER = ("conv", "turn", "role", "content")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows without texts, with a number that rises in the order of conversations and their turns."""
    words = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(*ORDER, (words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.rand(7).alias("spread"))
    dealt = slim.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ORDER), "spread").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ORDER))
    return materialize(dealt.drop("spread").withColumn("row", F.monotonically_increasing_id()), "turns")


def _blocks(numbered: DataFrame) -> DataFrame:
    """One row for each block of a conversation: its symbols, facts about its rows, and whether others come before or after."""
    repeated = numbered.groupBy(F.col("conv").alias("c"), F.col("content").alias("k")).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    flagged = numbered.join(repeated, _same(F.col("conv"), F.col("c")) & (F.col("content") == F.col("k")), "left")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    symbol = F.when(F.col("blank"), F.lit("b")).when(F.col("first") != F.col("row"), F.lit("d")).when(F.col("cut"), F.upper(code)).otherwise(code)
    block = F.shiftright("row", BLOCK_BITS)
    items = flagged.select("conv", block.alias("block"), F.struct("row", symbol.alias("symbol"), initial.alias("initial"), "turn").alias("item"), F.struct("turn", "role", "content").alias("head"))
    grouped = items.groupBy("conv", "block").agg(F.array_sort(F.collect_list("item")).alias("items"), F.min_by("head", F.col("item.row")).alias("head"))
    turns = F.array_distinct(F.array_compact(F.col("items.turn")))
    initials = F.col("items.initial")
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size(initials) - 1), F.slice(initials, F.lit(2), F.size(initials)), lambda a, b: F.concat(a, b))
    facts = grouped.select(
        "conv", "block", "head",
        F.array_join(F.col("items.symbol"), "").alias("symbols"),
        F.size(turns).cast("long").alias("turns"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.element_at(initials, 1).alias("opens"), F.element_at(initials, -1).alias("closes"),
    )
    bounds = numbered.groupBy(F.col("conv").alias("c")).agg(F.min(block).alias("least"), F.max(block).alias("most")).where("least < most")
    joined = facts.join(bounds, _same(F.col("conv"), F.col("c")), "left")
    return joined.withColumns({"first": F.coalesce(F.col("block") == F.col("least"), F.lit(True)), "last": F.coalesce(F.col("block") == F.col("most"), F.lit(True))}).drop("c", "least", "most")


def _with(df: DataFrame, added: str, work, dropped: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow that keeps the columns but those dropped, and adds some. ``work`` gets a batch and gives arrays."""
    kept = [f for f in df.schema.fields if f.name not in dropped]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    made = work()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = made()
        for batch in batches:
            new = step(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])

    return df.mapInArrow(run, schema)


def _aligned():
    """Costs and audits by (state before, state after), for the states in which a block can begin."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            costs, audits = [], []
            for symbols, first, last in zip(*(batch.column(n).to_pylist() for n in ("symbols", "first", "last")), strict=True):
                found = [o for e in range(4) for o in (alignments(symbols, e, last) if e == START or not first else (None,) * 4)]
                costs.append([o and o[0] for o in found])
                audits.append([o and o[1] for o in found])
            return {"costs": pa.array(costs, pa.list_(pa.int64())), "audits": pa.array(audits, pa.list_(pa.string()))}

        return step

    return begin


def _options(costs: list, audits: list, entry: int) -> list[tuple[int, str] | None]:
    return [None if c is None else (c, a) for c, a in zip(costs[4 * entry : 4 * entry + 4], audits[4 * entry : 4 * entry + 4], strict=True)]


ACCEPTED = [0, FAR, FAR, 0]


def _backward():
    """What it costs to finish behind a block, by state; blocks come last first."""

    def begin():
        ahead = ACCEPTED

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            nonlocal ahead
            found = []
            for costs, last in zip(batch.column("costs").to_pylist(), batch.column("last").to_pylist(), strict=True):
                if last:
                    ahead = ACCEPTED
                found.append(ahead)
                ahead = [min((c + a for c, a in zip(costs[4 * e : 4 * e + 4], ahead, strict=True) if c is not None), default=FAR) for e in range(4)]
            return {"ahead": pa.array(found, pa.list_(pa.int64()))}

        return step

    return begin


def _forward():
    """The chosen audit of each block, and what its first row adds to the facts; blocks come first first."""

    def begin():
        state, closes, high = START, None, None

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            nonlocal state, closes, high
            cost, audit, pair, again = [], [], [], []
            for r in batch.select(["first", "costs", "audits", "ahead", "opens", "closes", "low", "high"]).to_pylist():
                if r["first"]:
                    state, closes, high = START, None, None
                state, c, a = _choice(_options(r["costs"], r["audits"], state), r["ahead"])
                cost.append(c)
                audit.append(a)
                pair.append(int(closes is not None and closes + r["opens"] not in ("su", "ua", "au")))
                again.append(int(high is not None and high == r["low"]))
                closes, high = r["closes"], r["high"] if r["high"] is not None else high
            return {"cost": pa.array(cost, pa.int64()), "audit": pa.array(audit, pa.string()), "pair": pa.array(pair, pa.int64()), "again": pa.array(again, pa.int64())}

        return step

    return begin


def _single():
    """The chosen audit of a conversation within one block."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            chosen = [_choice(list(alignments(s, START, True)), ACCEPTED) for s in batch.column("symbols").to_pylist()]
            return {"cost": pa.array([c for _, c, _ in chosen], pa.int64()), "audit": pa.array([a for _, _, a in chosen], pa.string())}

        return step

    return begin


def repairs(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each block of a conversation: its place, facts about its rows, its part of the cost and the audit."""
    small_batches(conversations.sparkSession)
    blocks = _blocks(_numbered(_prepared(conversations, conv_col, turn_col, role_col, text_col)))
    blocks = materialize(blocks, "blocks")
    done = _with(blocks.where("first AND last"), "cost bigint, audit string", _single).withColumns({"pair": F.lit(0).cast("long"), "again": F.lit(0).cast("long")})
    # The join's side of a long conversation is dealt over all tasks before its blocks are aligned.
    long = blocks.where("NOT (first AND last)").repartition("conv", "block")
    aligned = _with(long, "costs array<bigint>, audits array<string>", _aligned)
    back = _with(aligned.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.desc("block")), "ahead array<bigint>", _backward)
    forth = _with(back.sortWithinPartitions(F.col("conv").asc_nulls_first(), "block"), "cost bigint, audit string, pair bigint, again bigint", _forward, ("costs", "audits", "ahead"))
    return materialize(done.unionByName(forth), "repairs")


def audits(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From ``repairs``: one row for each conversation with its faults, the cost and the audit."""
    count = lambda symbols: F.sum(F.char_length("symbols") - F.char_length(F.translate("symbols", symbols, ""))).cast("long")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("again")), F.lit(0)).cast("long")
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    return found.groupBy(F.col("conv").alias(conv_col)).agg(
        gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("SUAO").alias("truncated"),
        F.sum(F.col("illegal") + F.col("pair")).alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts["audit"], "").alias("audit"),
    )


def repaired_turns(conversations: DataFrame, found: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit, role and text.

    A conversation's turns lie in one partition, one behind another and in order."""
    small_batches(conversations.sparkSession)
    texts = _prepared(conversations, conv_col, turn_col, role_col, text_col).select(*ORDER, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "text")
    edits = found.select("conv", "head.turn", "head.role", "head.content", F.lit(0).alias("kind"), "block", F.col("audit").alias("text"))
    mixed = edits.unionByName(texts).repartition("conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in (*ORDER, "kind", "block")))
    conv_type = mixed.schema["conv"].dataType.simpleString()
    rows = mixed.select("conv", "kind", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state, place, letters = None, False, START, 0, deque()
        kind_of = None

        def made(edit: str, role: str | None, text: str) -> tuple:
            nonlocal state, place
            if edit == "K" and state == START and role[:1] == "s":
                state = SYSTEM
            else:
                state = DONE if state == USER else USER
            if edit != "K":
                role = "user" if state == USER else "assistant"
            place += 1
            return now, place - 1, edit, role, text

        def inserted() -> Iterator[tuple]:
            while letters and (not letters[0] or letters[0][0] == "I"):
                part = letters.popleft()
                if part:
                    yield made("I", None, "")
                    letters.appendleft(part[1:])

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (kind_of, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[conv_col, "place", "edit", "role", "text"])

        for batch in batches:
            kind_of = batch.schema.field("conv").type
            out: list[tuple] = []
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    out.extend(inserted())
                    now, begun, state, place, letters = conv, True, START, 0, deque()
                if kind == 0:
                    letters.append(text)
                    continue
                out.extend(inserted())
                part = letters.popleft()
                if part[0] != "D":
                    out.append(made(part[0], role, text))
                letters.appendleft(part[1:])
            yield batch_of(out)
        if begun:
            yield batch_of(list(inserted()))

    return rows.mapInArrow(work, f"`{conv_col}` {conv_type}, place bigint, edit string, role string, text string")


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From ``repaired_turns``: the SHA-256 of each conversation's ``role:text`` lines, read one row at a time."""
    conv_type = turns.schema[conv_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, kind_of = None, None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind_of), pa.array([h for _, h in out], pa.string())], names=[conv_col, "sha256"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            out = []
            for conv, place, role, text in zip(*(batch.column(n).to_pylist() for n in (conv_col, "place", "role", "text")), strict=True):
                if place == 0:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield batch_of(out)
        if sha:
            yield batch_of([(now, sha.hexdigest())])

    return turns.select(conv_col, "place", "role", "text").mapInArrow(work, f"`{conv_col}` {conv_type}, sha256 string")
