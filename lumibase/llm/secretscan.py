"""Secret scans: given patterns, and character Markov models of random strings and of ordinary identifiers.

The base patterns find assignments of long values, access keys and long hex strings. Their values are the labelled samples
of random strings; the other long tokens of all documents are those of ordinary identifiers. Each different string counts
once, so what is copied or common teaches no more than the rest. First-order models are counted from them: how often a
character follows another one (or begins). A token of the documents that no base match covers is a secret if the logarithm
of its likelihood ratio exceeds the logarithm of how many more ordinary than random samples there are, plus a margin.

Everything is built-in functions. The places of matches come from splitting at the pattern: what lies between matches and
the matches alternate, and running sums of their lengths are the places. Sums are taken in blocks, so a text with very many
matches takes time in proportion to them. Only the counted pairs of an alphabet of 68 characters go to the driver, and the
model is one literal array in the plan.

Defined results: a null text counts as ''. Places are in code points, ends exclusive. Candidates lie between assignments
(long enough or not), are maximal runs of at least ``LEAST`` characters, and have no access key and no hex string
in them. Without a base match in all documents there is no model, and only base matches are found (none). Repeated rows,
null ids and all other columns are kept; columns named ``base`` and ``secrets`` are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import text_or_empty

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # in a run of these characters that is shorter, no later AKIA has enough
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Characters of a candidate and of an ordinary token, of which the first has this length at least.
TOKEN, LEAST, LEAST_ORDINARY = "[A-Za-z0-9+/_=-]", 16, 8
#: A pair of characters as one number: previous (0 at the beginning) times this, plus the next.
WIDTH = len(ALPHABET) + 1
#: Numbers summed at once for running sums.
SUMMED = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that is used several times, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Inclusive running sums of an array of bigint: those of whole blocks, and the sum within a block."""

    def summed(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / SUMMED).cast("int")), lambda b: _total(F.slice(n, b * SUMMED + 1, F.lit(SUMMED))))

        def within(before: Column) -> Column:
            place = lambda i: F.floor(i / SUMMED).cast("int")
            return F.transform(n, lambda _, i: F.element_at(before, place(i) + 1) + _total(F.slice(n, place(i) * SUMMED + 1, i % SUMMED + 1)))

        return let(let(blocks, lambda b: F.transform(b, lambda _, i: _total(F.slice(b, F.lit(1), i)))), within)

    return let(numbers, lambda n: F.when(F.size(n) > 0, summed(n)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, as array of (start, end, text)."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(found, between, lambda m, g: (F.char_length(m) + F.char_length(g)).cast("long"))
        return F.zip_with(found, running(sizes), lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("text")))

    none = F.array().cast("array<struct<start: bigint, end: bigint, text: string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _assigned(text: Column) -> Column:
    """Assignments with values that are long enough, as (start, end, text) with the value as text."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(matches(text, ASSIGN), values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), v.alias("text")))
    return F.when(text.rlike(ASSIGN), F.filter(both, lambda m: F.char_length(m["text"]) >= LEAST_VALUE)).otherwise(matches(F.lit(""), HEX))


def _base(text: Column) -> list[Column]:
    return [_assigned(text), matches(text, ACCESS), matches(text, HEX)]


def _pairs(token: Column) -> Column:
    """A token's pairs of characters as numbers, the beginning included."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    return let(codes, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, F.lit(1), F.size(c) - 1)), c, lambda a, b: a * WIDTH + b))


@dataclass(frozen=True)
class Model:
    """Logarithms of the likelihood ratio by pair, and the least sum of a secret."""

    ratios: tuple[float, ...]
    least: float

    def ratio(self, token: Column) -> Column:
        table = F.split(F.lit(",".join(f"{r:.3f}" for r in self.ratios)), ",").cast("array<double>")  # folded to one literal
        return F.aggregate(_pairs(token), F.lit(0.0), lambda total, pair: total + F.element_at(table, pair + 1))


def train(docs: DataFrame, *, text_col: str = "text", margin: float = 5.0, smoothing: float = 0.5) -> Model | None:
    """The model of all documents; None without a base match. ``smoothing`` is added to each count of pairs."""
    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(text.alias("text"))
    kept = rows.withColumns({f"base{n}": b for n, b in enumerate(_base(F.col("text")))})
    values = F.flatten(F.array(*(F.col(f"base{n}.text") for n in range(3))))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.when(rest.rlike(pattern), F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    ordinary = F.regexp_extract_all(F.when(F.size(values) > 0, rest).otherwise(F.col("text")), F.lit(f"{TOKEN}{{{LEAST_ORDINARY},}}"), F.lit(0))
    labelled = kept.select(values.alias("values"), ordinary.alias("ordinary"))
    samples = labelled.select(F.explode(F.concat(F.transform("values", lambda v: F.struct(F.lit(1).alias("label"), v.alias("token"))), F.transform("ordinary", lambda v: F.struct(F.lit(0).alias("label"), v.alias("token"))))).alias("s"))
    # a token with both labels is a random string
    once = samples.groupBy("s.token").agg(F.max("s.label").alias("label"))
    counted = once.select("label", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").count()
    counts = [[0.0] * (WIDTH * WIDTH) for _ in range(2)]
    for r in counted.collect():  # at most 2 * WIDTH * WIDTH rows
        counts[r.label][r.pair] = r["count"]
    begun = [sum(c[:WIDTH]) for c in counts]
    if not begun[1]:
        return None
    ratios = [0.0] * (WIDTH * WIDTH)
    for a in range(WIDTH):
        sums = [sum(c[a * WIDTH : (a + 1) * WIDTH]) + smoothing * len(ALPHABET) for c in counts]
        for b in range(1, WIDTH):
            n, m = (c[a * WIDTH + b] + smoothing for c in counts)
            ratios[a * WIDTH + b] = math.log(m / sums[1]) - math.log(n / sums[0])
    return Model(tuple(ratios), max(0.0, math.log(max(1.0, begun[0]) / begun[1])) + margin)


def _added(text: Column, model: Model) -> Column:
    """The secrets by the model alone, as (start, end, text)."""
    pattern = f"{TOKEN}{{{LEAST},}}"

    def fitting(m: Column) -> Column:
        return ~m["text"].rlike(HEX) & ~m["text"].rlike(ACCESS) & (model.ratio(m["text"]) > model.least)

    whole = F.filter(matches(text, pattern), fitting)
    # the pieces between assignments, and where they begin
    pieces = F.split(text, ASSIGN, -1)
    ends = F.concat(F.array(F.lit(0).cast("long")), matches(text, ASSIGN)["end"])

    def within(piece: Column, at: Column) -> Column:
        found = F.filter(matches(piece, pattern), fitting)
        return F.transform(found, lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["text"].alias("text")))

    return F.when(text.rlike(ASSIGN), F.flatten(F.zip_with(pieces, ends, within))).otherwise(whole)


def scan(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``secrets`` (base and added ones): arrays of (start, kind, end) by start and kind as listed."""
    text = text_or_empty(f"`{text_col}`")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "secrets")]
    # the caller's columns keep away from ours until the end
    own = docs.select(F.struct(*kept).alias("row"), text.alias("text"))
    found = own.select("row", *(b.alias(KINDS[n]) for n, b in enumerate(_base(F.col("text")))), (_added(F.col("text"), model) if model else matches(F.lit(""), HEX)).alias(KINDS[3]))

    def marked(kind: int) -> Column:
        return F.transform(KINDS[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def listed(kinds: range) -> Column:
        return F.array_sort(F.concat(*map(marked, kinds)))

    return found.select("row", listed(range(3)).alias("base"), listed(range(4)).alias("secrets")).select("row.*", "base", "secrets")


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
