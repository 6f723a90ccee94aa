"""I-Match fingerprints over randomised lexicon subsets.

The lexicon has the terms whose document frequency lies in a band: in at least ``least_share`` and at most
``most_share`` of the different texts (and in two at least). Copies of a text count once, so that a text which many
rows repeat keeps its terms. The lower end bounds the lexicon: a document has ``d`` different terms on average, so no
more than ``d / least_share`` terms can be in so many documents, whatever the corpus's size. Up to ``most_held`` terms
it is held in the plan as a hash table of 64-bit hashes, told apart slot by slot, so no term outside of the band counts
as one of it. A larger lexicon stays a table, and is joined to the documents' terms.

The lexicon is dealt at random, by a keyed hash, into disjoint subsets, once for each number in ``SUBSETS`` (few large
subsets, which whole texts share, and many small ones, which parts of texts share). Of each subset that a document has
terms of, these are sorted and hashed; the numbers of these subsets with their hashes are the fingerprint. A subset
without terms has no place in it, so none can be mistaken for empty. Two texts agree on a subset if all of its terms
that the one has, the other has too. Their likeness is the share of agreeing subsets among those that either has terms
of.

Only built-in functions are used. The terms of a document are found once a pass, and frequencies are summed before the
shuffle.

Defined results: a null or empty text, and one without terms of the lexicon, has an empty fingerprint; two such
texts are alike (1.0). Equal texts have equal fingerprints. Null ids come before all others; rows that repeat an id
follow each other by a hash of the text. The text after the last is the first, so a single row is followed by itself.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lumibase.llm.shared import materialize, text_or_empty

#: Numbers of subsets that the lexicon is dealt into; each has its own key.
SUBSETS = (64, 2048)
#: Bits of the bitmap of copied texts, most terms of a lexicon that is held in the plan, and most blocks of neighbours.
BITMAP_BITS, MOST_HELD, MOST_BLOCKS = 1 << 20, 1 << 18, 1 << 14
#: Characters of a subset's number and of its hash in the fingerprint.
NUMBER, DIGITS = 3, 5
#: As a length, all that is left of a string.
REST = (1 << 31) - 1


def terms(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def _longs(numbers: list[int]) -> Column:
    """A constant array; Spark folds the expression once, when it plans."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def _place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BITMAP_BITS))


def _bitmap(places: DataFrame) -> Column:
    """The bitmap of a table of places (column place), as an array of 64-bit words."""
    found = (
        places.select((F.col("place") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
        .collect()  # at most BITMAP_BITS / 64 rows
    )
    bits = dict(found)
    return _longs([bits.get(n, 0) for n in range(BITMAP_BITS // 64)])


def _marked(bitmap: Column, place: Column) -> Column:
    word = F.element_at(bitmap, (place / 64).cast("int") + 1)
    return F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def different_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Each text once (column text). Only texts whose hash may occur again, told by a bitmap, are dealt by text; copies
    are dropped before the shuffle and after it. The bitmap never misses a copy."""
    text = F.col(text_col)
    again = docs.groupBy(F.xxhash64(text).alias("hash")).count().where("count > 1")
    copied = _marked(_bitmap(again.select(F.pmod("hash", F.lit(BITMAP_BITS)).alias("place"))), _place(text))
    rows = docs.select(text.alias("text"), copied.alias("copied"))
    return rows.where("NOT copied").select("text").union(rows.where("copied").select("text").distinct())


def lexicon(docs: DataFrame, text_col: str, least_share: float, most_share: float) -> DataFrame:
    """The terms (column term) whose document frequency is in the band, as a written table."""
    total = docs.select(F.xxhash64(text_col).alias("hash")).distinct().count()
    words = different_texts(docs, text_col).select(F.explode(terms(F.col("text"))).alias("term"))
    counted = words.groupBy("term").agg(F.count("*").alias("n"))
    return materialize(counted.where(F.col("n").between(max(2, least_share * total), max(2, most_share * total))).select("term"), "lexicon")


def _holds(band: DataFrame, n: int):
    """A test of a hash against those of the terms, by a hash table of at most ``MOST_HELD`` terms: the hashes by their
    remainder, and where those of each remainder begin."""
    size = 2 * max(1, n)
    hashes = sorted((h % size, h) for (h,) in band.select(F.xxhash64("term")).distinct().collect())
    counts = [0] * (size + 1)
    for slot, _ in hashes:
        counts[slot + 1] += 1
    begins, held = _longs(list(accumulate(counts))), _longs([h for _, h in hashes])

    def holds(h: Column) -> Column:
        slot = F.pmod(h, F.lit(size)).cast("int")
        first, end = F.get(begins, slot).cast("int"), F.get(begins, slot + 1).cast("int")
        return (end > first) & ((F.get(held, first) == h) | ((end > first + 1) & F.array_contains(F.slice(held, first + 1, end - first), h)))

    return holds


def with_banded(df: DataFrame, text_col: str, out: str, band: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """Adds the terms of a text that are in the lexicon."""
    n = band.count()
    if n <= most_held:
        holds = _holds(band, n)
        return df.withColumn(out, F.filter(terms(F.col(text_col)), lambda term: holds(F.xxhash64(term))))
    # rows are told apart by a hash of the text: equal texts have equal terms
    key = F.xxhash64(text_col)
    words = df.select(key.alias("_text"), F.explode(terms(F.col(text_col))).alias("term")).distinct()
    found = words.join(band, "term", "left_semi").groupBy("_text").agg(F.collect_set("term").alias(out))
    return df.withColumn("_text", key).join(found, "_text", "left").drop("_text").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _dealt(banded: Column, key: int) -> Column:
    """A line for each subset of one dealing that there are terms of: its number, then its terms in order."""
    made = F.array_sort(F.transform(banded, lambda t: F.concat(_number(F.pmod(F.xxhash64(t, F.lit(key + 1)), F.lit(SUBSETS[key])), key), t)))
    number = lambda p: F.substring(p, 1, NUMBER)

    def lines(pairs: Column) -> Column:
        again = lambda p, n: (n > 0) & (number(F.get(pairs, n - 1)) == number(p))
        return F.transform(pairs, lambda p, n: F.when(again(p, n), F.concat(F.lit(" "), F.substring(p, NUMBER + 1, REST))).otherwise(F.concat(F.lit("\n"), p)))

    # a lambda's variable binds the sorted array; as a column's expression it would be sorted again for each term
    joined = F.get(F.transform(F.array(made), lambda pairs: F.array_join(lines(pairs), "")), F.lit(0))
    return F.split(joined, "\n")


def _number(n: Column, key: int) -> Column:
    return F.lower(F.lpad(F.hex(n + sum(SUBSETS[:key])), NUMBER, "0"))


def with_fingerprint(df: DataFrame, text_col: str, out: str, band: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """Adds the fingerprint of a text. Each step is a column of its own, so that no step is done again for each term."""
    made = with_banded(df, text_col, "_banded", band, most_held)
    made = made.withColumns({f"_dealt{k}": _dealt(F.col("_banded"), k) for k in range(len(SUBSETS))})
    lines = F.array_remove(F.concat(*(F.col(f"_dealt{k}") for k in range(len(SUBSETS)))), "")
    digest = lambda line: F.lower(F.lpad(F.hex(F.xxhash64(F.substring(line, NUMBER + 1, REST))), 16, "0"))
    places = F.transform(lines, lambda line: F.concat(F.substring(line, 1, NUMBER), F.substring(digest(line), 1, DIGITS)))
    return made.withColumn(out, F.array_join(places, " ")).drop("_banded", *(f"_dealt{k}" for k in range(len(SUBSETS))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal subsets among those that either fingerprint has terms of; 1.0 if neither has any."""
    places = lambda x: F.array_remove(F.split(x, " "), "")
    subsets = lambda x: F.transform(places(x), lambda p: F.substring(p, 1, NUMBER))
    same = F.size(F.array_intersect(places(a), places(b)))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.size(F.array_union(subsets(a), subsets(b))))


def _block_of(bound, n: int, key: Column) -> Column:
    """How many bounds are at most the key, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (bound(at + step - 1) <= key), at + step).otherwise(at))


def _bounds(df: DataFrame, order: list[str], rows_a_block: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Places (two longs each, as ``order`` names them) that cut the rows into blocks, and the least place. Only the
    places are sorted, not the rows; of each sorted partition every so many-th one is a bound."""
    places = df.select(*order)
    total = places.count()
    step = max(rows_a_block, -(-total // MOST_BLOCKS))
    # within a partition of a sorted table the lower 33 bits of this number count the rows
    ranked = places.orderBy(*order).withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    cuts = sorted({(r[0], r[1]) for r in ranked.where(F.col("n") % step == 0).select(*order).collect()})  # at most MOST_BLOCKS and one a partition
    return cuts[1:], cuts[0] if cuts else None


def with_next(df: DataFrame, order: list[str], lead: list[str], rows_a_block: int = 256) -> DataFrame:
    """Adds next_<column> of the row that follows by the two columns of longs (never null) in ``order``, and after the
    last of the first.

    Rows go to blocks of neighbouring places by one shuffle. A block's bounds are places that occur, so the row after a
    block's last is the one at the next bound; that row goes to both blocks. Rows of one place are equal to the caller."""
    bounds, least = _bounds(df, order, rows_a_block)
    if least is None:
        return df.withColumns({f"next_{c}": F.col(c) for c in lead})
    struct = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    at = struct(F.col(order[0]), F.col(order[1]))
    literal = tuple(_longs([x[n] for x in bounds]) for n in (0, 1))
    place = lambda n: struct(F.get(literal[0], n), F.get(literal[1], n))
    block = _block_of(place, len(bounds), at)
    made = df.withColumn("_block", block)
    starts = (F.col("_block") > 0) & (place(F.col("_block") - 1) == at)
    copies = F.array_compact(
        F.array(
            F.struct(F.col("_block").alias("block"), F.lit(0).alias("guest")),
            F.when(starts, F.struct((F.col("_block") - 1).alias("block"), F.lit(1).alias("guest"))),
            F.when(at == struct(F.lit(least[0]), F.lit(least[1])), F.struct(F.lit(len(bounds)).alias("block"), F.lit(2).alias("guest"))),
        )
    )
    placed = made.withColumn("_copy", F.explode(copies)).select("*", "_copy.block", "_copy.guest").drop("_copy", "_block")
    window = W.Window.partitionBy("block").orderBy("guest", *order)
    followed = placed.withColumns({f"next_{c}": F.lead(c).over(window) for c in lead})
    return followed.where("guest = 0").drop("block", "guest")


def fingerprints_of_edits(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.01, most_share: float = 0.2, most_held: int = MOST_HELD
) -> DataFrame:
    """Per row: id, n_chars, edited (the text whose last half is replaced by the head of the next text), fingerprint,
    edited_fingerprint, next_fingerprint."""
    docs = df.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    band = lexicon(docs, "text", least_share, most_share)
    docs = docs.withColumns({"key": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "hash": F.xxhash64("text")})
    followed = with_next(with_fingerprint(docs, "text", "fingerprint", band, most_held), ["key", "hash"], ["text", "fingerprint"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    made = followed.select(F.col(id_col), F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    return with_fingerprint(made, "edited", "edited_fingerprint", band, most_held)
